"""Errors: for each area one for bad data or requests, and one for bad configuration."""


class TallyError(Exception):
    """Base of all errors raised here."""


class InputError(TallyError, ValueError):
    """Data or a request that an operator can't work on."""


class ConfigError(TallyError, ValueError):
    """Rules, thresholds or sources that contradict themselves."""


class IngestError(InputError): ...


class NormalizeError(InputError): ...


class CategoryInputError(InputError): ...


class CategoryConfigError(ConfigError): ...


class RecurrenceInputError(InputError): ...


class RecurrenceConfigError(ConfigError): ...


class QualityInputError(InputError): ...


class LookupInputError(InputError): ...


class SpendInputError(InputError): ...


class RecurringInputError(InputError): ...


class ExplainInputError(InputError): ...
