"""Declared schemas of the procurement tables (Spark DDL)."""

# The six procurement tables as they are stored: money as NUMERIC.
CONTRACT_SCHEMAS = {
    "categories": "category_id INT, category_name STRING, description STRING",
    "suppliers": (
        "supplier_id INT, supplier_name STRING, contact_person STRING, email STRING, "
        "phone STRING, street STRING, postal_code STRING, city STRING, country STRING, "
        "website STRING, shop_url STRING, payment_terms STRING, notes STRING, "
        "created_at TIMESTAMP_NTZ"
    ),
    "articles": (
        "article_id INT, ean STRING, article_name STRING, brand STRING, manufacturer STRING, "
        "description STRING, category_id INT, unit STRING, weight_kg DECIMAL(10,3), "
        "is_active BOOLEAN, created_at TIMESTAMP_NTZ"
    ),
    "contracts": (
        "contract_id INT, contract_number STRING, supplier_id INT, title STRING, "
        "version STRING, status STRING, valid_from DATE, valid_until DATE, "
        "payment_terms STRING, delivery_terms STRING, currency STRING, "
        "minimum_order_value DECIMAL(10,2), free_shipping_threshold DECIMAL(10,2), "
        "notes STRING, created_at TIMESTAMP_NTZ"
    ),
    "contract_articles": (
        "contract_article_id INT, contract_id INT, article_id INT, "
        "contract_price DECIMAL(10,2), list_price DECIMAL(10,2), discount_pct DECIMAL(5,2), "
        "min_order_qty INT, delivery_days INT, is_preferred BOOLEAN, notes STRING"
    ),
    "tiered_pricing": (
        "tier_id INT, contract_article_id INT, min_quantity INT, max_quantity INT, "
        "tier_price DECIMAL(10,2), discount_pct DECIMAL(5,2)"
    ),
}

# NUMERIC money columns, turned into ``<name>_cents`` BIGINT on load.
MONEY_COLUMNS = (
    "contract_price",
    "list_price",
    "tier_price",
    "minimum_order_value",
    "free_shipping_threshold",
)

# Offer sources in arrival order: earlier sources win first-come rules.
SOURCE_ORDER = ("idealo", "geizhals", "google_shopping")
