"""Word lists, patterns and constants shared by the whole package.

Everything here is a fixed value: results depend on the exact words, patterns and numbers.
"""

from __future__ import annotations

# ---- fixed values: boolean tokens -------------------------------------------------------------
BOOL_TRUE = ("true", "1", "sí", "si")
BOOL_FALSE = ("false", "0", "no")
BOOL_STRICT = BOOL_TRUE + BOOL_FALSE
BOOL_WIDE = ("0", "1", "true", "false", "t", "f", "si", "sí", "no", "y", "n")
COUNT_TRUE = ("sí", "si", "true", "1", "t", "y")
COUNT_FALSE = ("no", "false", "0", "f", "n")
KPI_TRUE = ("true", "1", "t", "y", "sí", "si")

# ---- fixed values: patterns -------------------------------------------------------------------
MONEY_SYMBOL_PATTERN = r"[$€£]|^\s*[A-Z]{2,3}\s*\d"
MONEY_CODE_PATTERN = r"(?i)[$€£]|CLP|USD|EUR|MXN|ARS|BRL|PEN|GBP|COP|UYU"
MONEY_FEATURE_PATTERN = r"(?i)[$€£]|CLP|USD|EUR|MXN|ARS|BRL|PEN"
CODE_PATTERN = r"^[A-Za-z0-9\-_\/\.]{4,}$"
ISO_DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# ---- fixed values: date text and range --------------------------------------------------------
DATE_FORMATS = ("%Y-%m-%d", "%d/%m/%Y", "%Y/%m/%d")
DATE_MIN = "1677-09-22"
DATE_MAX = "2262-04-11"

# ---- fixed values: currency prefix on value axes ----------------------------------------------
CURRENCY_PREFIX = {
    "CLP": "$",
    "USD": "USD ",
    "EUR": "€",
    "GBP": "£",
    "ARS": "ARS ",
    "MXN": "MX$ ",
    "BRL": "R$ ",
    "PEN": "S/ ",
}
CURRENCY_IN_TEXT = (
    ("USD", r"\bUSD\b|\$"),
    ("EUR", r"€|\bEUR\b"),
    ("GBP", r"£|\bGBP\b"),
    ("CLP", r"\bCLP\b|\$"),
)

# ---- fixed values: text read as missing in delimited files ------------------------------------
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# ---- fixed values: role names -----------------------------------------------------------------
DATE, MONEY, NUMBER, TEXT, BOOL = "fecha", "moneda", "numérico", "texto", "bool"
MONEY_METRIC, NUMBER_METRIC = "métrica_monetaria", "métrica_numérica"
CATEGORY, ID, LAT, LON, GEO = "categórica", "id", "geo_lat", "geo_lon", "geo"
PROFILE_AMOUNT, PROFILE_CATEGORY = "monto", "categoría"
ROLE_LABELS = (DATE, MONEY_METRIC, NUMBER_METRIC, CATEGORY, BOOL, ID, GEO, TEXT)

# ---- fixed values: name rules of the profile roles, first match wins --------------------------
PROFILE_NAME_RULES = (
    (DATE, ("fecha", "date", "fcha")),
    (PROFILE_AMOUNT, ("monto", "importe", "amount", "total")),
    (MONEY, ("moneda", "currency")),
    (ID, ("id_", "id-", "id ")),
    (BOOL, ("bool", "flag", "activo", "enable", "enabled")),
    (PROFILE_CATEGORY, ("cat", "tipo", "segmento", "grupo", "clase")),
)

# ---- fixed values: name rules of the business roles, first match wins -------------------------
BUSINESS_NAME_RULES = (
    (DATE, ("fecha", "date", "dia", "día", "month", "year", "timestamp", "periodo", "período")),
    (MONEY_METRIC, ("monto", "importe", "amount", "revenue", "ventas", "total", "valor", "price_total")),
    (NUMBER_METRIC, ("precio_unit", "unit_price", "precio")),
    (NUMBER_METRIC, ("qty", "cantidad", "units")),
    (ID, ("id", "folio", "codigo", "código", "nro", "numero", "número")),
)

# ---- fixed values: term lists of the semantic roles -------------------------------------------
ROLE_TERMS = {
    DATE: ("fecha", "date", "day", "month", "year", "timestamp", "periodo", "period", "fec", "fech"),
    MONEY_METRIC: ("monto", "importe", "amount", "revenue", "ventas", "price", "precio", "total", "valor",
                   "salary", "sueldo", "pay", "wage", "unit_price", "precio_unitario"),
    NUMBER_METRIC: ("cantidad", "qty", "units", "score", "porcentaje", "percent", "ratio", "count",
                    "duración", "duration", "tiempo", "time", "age", "edad", "stock", "inventory"),
    BOOL: ("flag", "is_", "has_", "true", "false", "sí", "si", "no", "activo", "inactivo", "active", "enabled"),
    ID: ("id", "code", "codigo", "uuid", "nro", "numero", "folio", "order_id", "invoice_id"),
    CATEGORY: ("categoría", "category", "tipo", "clase", "segmento", "producto", "cliente", "departamento",
               "ciudad", "estado", "moneda", "brand", "region", "región", "prioridad", "canal"),
    GEO: ("lat", "latitude", "lon", "longitud", "long", "lng", "geo", "coordinates"),
}

# ---- fixed values: domain keywords, first match wins ------------------------------------------
DOMAIN_RULES = (
    ("hr", ("salary", "sueldo", "hire", "termination", "department", "employee", "hr")),
    ("sales", ("venta", "sales", "price", "order", "sku", "cliente", "invoice", "region", "canal")),
    ("procurement", ("proveedor", "purchase", "ap", "pago", "factura", "oc", "compras")),
    ("inventory", ("stock", "inventario", "warehouse", "bodega")),
)
BUSINESS_DOMAIN_RULES = (
    ("sales", ("venta", "ventas", "cliente", "producto", "sku", "pedido", "orden", "order", "invoice",
               "factura", "monto", "importe", "precio", "cantidad")),
    ("hr", ("empleado", "sueldo", "salary", "hr", "nomina", "nómina", "contrato")),
    ("logistics", ("envio", "envío", "transporte", "logística", "logistica", "tracking", "paquete")),
)

# ---- fixed values: names that steer the recommended dashboards --------------------------------
DATE_NAME = r"(?i)\bfecha\b|\bdate\b|\bfcha\b"
MONEY_NAME = r"(?i)\b(monto|importe|total|valor|precio|amount|revenue|sales)\b"
QUANTITY_NAME = r"(?i)\b(cantidad|qty|quantity|unidades|units)\b"
PRICE_NAME = r"(?i)\b(precio|price|valor_unit|unit[_ ]?price)\b"
DIM_PRIORITY = (
    "categoria", "category", "producto", "product", "cliente", "customer", "usuario", "user", "ciudad",
    "city", "region", "pais", "country", "metodo_pago", "medio_pago", "payment", "pago", "estado",
    "estatus", "status", "prioridad", "gerente", "canal", "tipo", "vendedor", "seller",
)
MEAN_WORDS = ("price", "precio", "rate", "ratio", "porcentaje", "percent", "avg", "average", "promedio", "unit")
ID_WORDS = ("id", "codigo", "code", "uuid", "nro", "numero")
FEATURE_AMOUNT_WORDS = ("monto", "importe", "amount", "revenue", "ventas", "price", "precio", "total",
                        "valor", "salary", "sueldo")
FEATURE_PERCENT_WORDS = ("pct", "%", "porc", "percent")

BUSINESS_DATE_NAME = r"\b(fecha|date|dia|día|timestamp|period)\b"
BUSINESS_TOTAL_NAME = r"total|importe|monto|revenue|ventas"
BUSINESS_QUANTITY_NAME = r"\b(qty|cantidad|units)\b"
BUSINESS_UNIT_PRICE_NAME = r"(precio_unit|unit_price|precio\b)"
BUSINESS_ORDER_NAME = r"(id|id_orden|id_pedido|order_id|invoice)"
BUSINESS_DIMS = {
    "categoria": (r"(categor[ií]a|category|segmento|tipo|brand)", 30),
    "producto": (r"(producto|sku|art[ií]culo|item)", 30),
    "ciudad": (r"(ciudad|city|comuna|region|región|estado|state)", 30),
    "cliente": (r"(cliente|customer|comprador|buyer|user)", 50),
    "pago": (r"(m[eé]todo_pago|metodo_pago|payment|forma_pago)", 30),
    "estado": (r"(estado|estatus|status)", 20),
}
SEMANTIC_QUANTITY_NAME = r"(?i)(qty|cantidad|units|cantidad_total)"
SEMANTIC_UNIT_PRICE_NAME = r"(?i)(unit_price|precio_unitario|precio)"

# ---- fixed values: meta fields of chart specs -------------------------------------------------
ROW_FIELD, COLUMN_FIELD, NULL_PCT_FIELD = "__row__", "__column__", "__null_pct__"
META_FIELDS = (ROW_FIELD, COLUMN_FIELD, NULL_PCT_FIELD)
REST_LABEL = "Otros"

# ---- fixed values: outlier detection ----------------------------------------------------------
OUTLIER_METHOD = "isolation_forest"
OUTLIER_COLUMNS = ("is_outlier", "outlier_score", "outlier_method")
CONTAMINATION, SEED, N_TREES, TREE_ROWS = 0.05, 42, 100, 256
EULER_GAMMA = 0.5772156649015329

# ---- fixed values: run status -----------------------------------------------------------------
STAGES = ("Subir archivo", "Perfilado", "Limpieza", "Dashboard", "Reporte")
STAGE_TITLES = {
    "ingesta": "Subir archivo", "subir": "Subir archivo", "upload": "Subir archivo",
    "perfilado": "Perfilado", "profiling": "Perfilado",
    "limpieza": "Limpieza", "cleaning": "Limpieza",
    "dashboard": "Dashboard",
    "reporte": "Reporte", "report": "Reporte",
}
STATUS_WORDS = {
    "ok": ("ok", "done", "success", "completed", "finished"),
    "running": ("running", "in_progress", "processing"),
    "failed": ("failed", "error"),
    "pending": ("pending", "queued", "waiting"),
}
