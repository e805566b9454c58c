"""Corpus profiles: which tables make up a corpus, and what a model is told of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Profile:
    name: str
    tables: tuple[str, ...]
    schema_card: str
    vector_dim: int = 768
    hidden: tuple[str, ...] = field(default=())  # never registered, so never readable
    replica: str | None = None


PROFILES = {
    p.name: p
    for p in (
        Profile("smoke", ("orders", "documents"), "orders(id, user_id, status, amount, created_at)\ndocuments(id, title, body, embedding)", 1024),
        Profile("bench", ("categories", "customers", "products", "orders", "order_items", "support_tickets", "documents"), "categories(id, name)\ncustomers(id, name, segment, region, created_at)\nproducts(id, name, category_id, price, supplier, active)\norders(id, customer_id, status, total, created_at)\norder_items(id, order_id, product_id, qty, unit_price)\nsupport_tickets(id, customer_id, order_id, reason, status, created_at)", 1024, ("admin_secrets",)),
        Profile("company", ("departments", "employees", "clients", "products", "contracts", "projects", "sales", "support_tickets", "document_chunks"), "departments, employees, clients, products, contracts, projects, sales, support_tickets, document_chunks"),
        Profile("star", ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"), "region, nation, customer, supplier, part, orders, lineitem, events, documents, embeddings", 64),
    )
}


def get_profile(name: str | None) -> Profile:
    """The named profile; nothing means smoke; an unknown name raises."""
    if not (name or "").strip():
        return PROFILES["smoke"]
    if name.strip() not in PROFILES:
        raise KeyError(f"unknown profile {name!r}; known: {', '.join(sorted(PROFILES))}")
    return PROFILES[name.strip()]


def register(spark: SparkSession, profile: Profile, folder: str) -> dict[str, DataFrame]:
    """Temporary views of the profile's tables under folder, or under its replica where the folder cannot be read."""
    out = {}
    for name in profile.tables:
        if name in profile.hidden:
            continue
        try:
            df = spark.read.parquet(f"{folder}/{name}.parquet")
        except Exception:
            if not profile.replica:
                raise
            df = spark.read.parquet(f"{profile.replica}/{name}.parquet")
        df.createOrReplaceTempView(name)
        out[name] = df
    return out


def describe(tables: dict[str, DataFrame]) -> dict[str, str]:
    """Columns of each table in order, as one text."""
    return {name: ", ".join(f"{c} {t}" for c, t in df.dtypes) for name, df in tables.items()}
