"""Small frames and row helpers that tests share."""

from datetime import datetime


def t(text):
    return datetime.fromisoformat(text) if text else None


ORDER_SCHEMA = (
    "order_id long, grp string, pay_time timestamp, refund_time timestamp, lock_time timestamp, invoice_time timestamp, "
    "deposit_time timestamp, assign_time timestamp, buyer_id string, buyer_phone string, product string, region string, age double"
)


def orders(spark, rows):
    """Order frame from dicts; missing fields are null."""
    names = [x.strip().split(" ")[0] for x in ORDER_SCHEMA.split(",")]
    data = []
    for k, row in enumerate(rows):
        row = {"order_id": k, "grp": "A", **row}
        data.append(tuple(t(row.get(n)) if n.endswith("_time") else row.get(n) for n in names))
    return spark.createDataFrame(data, ORDER_SCHEMA)


def rows_of(df, *cols):
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
