"""Fixed values that results depend on: vocabularies, aliases, thresholds and rule tables."""

# Header variants and the columns that they name.
HEADER_ALIASES = {
    "id": "transaction_id", "tx_id": "transaction_id", "transactionid": "transaction_id",
    "accountid": "account_id", "acct_id": "account_id",
    "date": "timestamp", "datetime": "timestamp", "created_at": "timestamp",
    "amt": "amount", "ccy": "currency",
    "merchantname": "merchant", "narration": "description",
    "accountname": "account_name", "accounttype": "account_type",
    "productid": "product_id", "productname": "product_name", "producttype": "product_type",
    "type": "item_type", "val": "value",
}

# Currency names and their codes.
CURRENCIES = {
    "ghs": "GHS", "ghc": "GHS", "cedi": "GHS", "cedis": "GHS", "ghana cedi": "GHS", "ghana cedis": "GHS",
    "gbp": "GBP", "pound": "GBP", "pounds": "GBP", "sterling": "GBP",
    "usd": "USD", "dollar": "USD", "dollars": "USD",
    "eur": "EUR", "euro": "EUR", "euros": "EUR",
}

# Raw category names and the baseline categories.
BASE_CATEGORIES = {
    "groceries": "groceries", "grocery": "groceries", "supermarket": "groceries",
    "transport": "transport", "transportation": "transport", "fuel": "transport", "ride": "transport", "rides": "transport",
    "salary": "income", "income": "income", "wages": "income",
    "bills": "bills", "bill": "bills", "utilities": "bills",
    "shopping": "shopping", "retail": "shopping",
    "food": "food_and_drink", "restaurant": "food_and_drink", "restaurants": "food_and_drink", "dining": "food_and_drink",
    "transfer": "transfers", "transfers": "transfers", "bank transfer": "transfers",
    "cash withdrawal": "cash", "withdrawal": "cash", "atm": "cash",
}

# Kinds of fees and limits, and kinds of accounts.
ITEM_TYPES = {"fee": "fee", "fees": "fee", "charge": "fee", "charges": "fee", "limit": "limit", "limits": "limit", "threshold": "limit"}
ACCOUNT_TYPES = {"current": "current", "checking": "current", "savings": "savings", "saving": "savings", "wallet": "wallet", "credit": "credit", "loan": "loan"}

# The mapped taxonomy.
CATEGORIES = ("income", "transfer", "groceries", "transport", "bills", "shopping", "entertainment", "healthcare", "education", "savings", "fees", "cash", "other")
SUBCATEGORIES = ("salary", "peer_transfer", "internal_transfer", "supermarket", "fuel", "ride_hailing", "utilities", "mobile_money", "subscriptions", "pharmacy", "tuition", "bank_fee", "atm_withdrawal", "general", "uncategorized")

# Merchant and category names that the mapping replaces.
MERCHANT_ALIASES = {
    "melcom gh": "melcom", "melcom ltd": "melcom", "shoprite gh": "shoprite", "shell retail": "shell", "total energies": "total",
    "uber bv": "uber", "bolt eu": "bolt", "vodafone cash": "vodafone", "mtn momo": "mtn", "ecobank mobile": "ecobank",
}
CATEGORY_ALIASES = {
    "supermarket": "groceries", "food groceries": "groceries", "grocery": "groceries", "fuel station": "transport", "taxi": "transport", "ride share": "transport", "utility": "bills",
    "subscription": "entertainment", "medical": "healthcare", "school": "education", "bank charges": "fees", "withdrawal": "cash", "unknown": "other", "misc": "other",
}

# Default rules (priority, field, how, value, category, subcategory, merchant).
RULES = (
    (10, "direction", "exact", "credit", "income", "salary", "salary"),
    (20, "category_normalized", "exact", "transfer", "transfer", "peer_transfer", None),
    (30, "merchant_normalized", "exact", "melcom", "groceries", "supermarket", None),
    (40, "merchant_normalized", "exact", "shell", "transport", "fuel", None),
    (50, "merchant_normalized", "exact", "uber", "transport", "ride_hailing", None),
    (60, "category_normalized", "exact", "utilities", "bills", "utilities", None),
    (70, "category_normalized", "exact", "bank_fee", "fees", "bank_fee", None),
    (80, "category_normalized", "exact", "atm_withdrawal", "cash", "atm_withdrawal", None),
)

# Domains of enumerated columns.
DIRECTIONS = ("credit", "debit")
CADENCES = ("none", "weekly", "biweekly", "monthly", "irregular")
CONFIDENCES = ("low", "medium", "high")

# Sentences of results.
NO_CONTEXT = "No relevant context found."
MIXED_LOOKUP = "Multiple currencies detected in lookup results. Values should not be combined implicitly."
MIXED_SPEND = "Multiple currencies detected. Totals are separated by currency and should not be combined implicitly."
MIXED_RECURRING = "Multiple or mixed currencies detected in recurring payment results. Values should not be combined implicitly."
NO_LOOKUP = "No transactions matched the provided filters."
NO_RECURRING = "No recurring payments matched the provided filters."
ALL_IRREGULAR = "All returned recurring payment records are marked as irregular."

# Bands of evaluation metrics (green from, orange from).
BANDS = {"mrr": (0.9, 0.75), "ndcg": (0.9, 0.75), "coverage": (90.0, 75.0), "accuracy": (4.5, 4.0), "completeness": (4.5, 4.0), "relevance": (4.5, 4.0)}
