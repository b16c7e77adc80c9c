"""Documents for queries over the relational tables: a registry whose words occur in ``documents``, and invoices rendered
as text lines from ``orders``, ``customer`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY = {
    "generic_fields": ["titre", "date"],
    "sensitive_fields": ["cin"],
    "categories": [
        {
            "name": "english", "folder": "English", "keywords": [r"\bthe\b", r"\bthis\b", r"\bwith\b"], "fields": ["objet", "date"], "file_name": {"prefix": "en", "parts": ["objet"]},
            "subfolders": [{"name": "Notices", "keywords": [r"\blicen[cs]e\b"]}, {"name": "Asides", "keywords": [r"\bwas\b"]}, {"name": "Autres", "keywords": []}],
        },
        {"name": "french", "folder": "French", "subfolders": [], "keywords": [r"\bles\b", r"\bpour\b", r"\bdans\b"], "fields": ["objet", "date"], "file_name": {"prefix": "fr", "parts": ["objet"]}},
        {"name": "german", "folder": "German", "subfolders": [], "keywords": [r"\bund\b", r"\bnicht\b", r"\bdie\b"], "fields": ["objet", "date"], "file_name": {"prefix": "de", "parts": ["objet"]}},
        {"name": "spanish", "folder": "Spanish", "subfolders": [], "keywords": [r"\blos\b", r"\bpara\b", r"\bcon\b"], "fields": ["objet", "date"], "file_name": {"prefix": "es", "parts": ["objet"]}},
    ],
    "rules": [{"description": "texts with an address and a number", "patterns": [r"@[a-z]+", r"\b\d{8,}\b"], "category": "english"}],
}

VARIANTS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def invoice_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, customer, issued, net, tax, gross, variant: what the rendered invoices say."""
    orders, lines, customers = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "customer"))
    net = lines.groupBy("l_orderkey").agg(F.sum(F.round("l_extendedprice", 2).cast("decimal(18,2)")).cast("decimal(18,2)").alias("net"))
    rows = orders.join(net, orders["o_orderkey"] == net["l_orderkey"]).join(customers, orders["o_custkey"] == customers["c_custkey"])
    tax = F.round(F.col("net") * F.lit("0.20").cast("decimal(3,2)"), 2).cast("decimal(18,2)")
    return rows.select(F.col("o_orderkey").alias("doc_id"), F.col("c_custkey").alias("customer"), F.col("c_name").alias("customer_name"), F.to_date("o_orderdate").alias("issued"), "net", tax.alias("tax"), (F.col("o_orderkey") % VARIANTS).cast("int").alias("variant"))


def written(amount: Column, european: Column) -> Column:
    plain = F.format_number(amount, 2)
    return F.when(european, F.translate(plain, ",.", ".,")).otherwise(F.translate(plain, ",.", " ,"))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, text, facts. Variants: 0 plain, 1 values on the next line, 2 European separators, 3 labels as OCR
    misreads them, 4 a total wrong by 100, 5 no tax and "net a payer", 6 a two-digit year, 7 two tax lines."""
    v, european = F.col("variant"), F.col("variant") == 2
    half = (F.floor(F.col("tax") * 50) / 100).cast("decimal(18,2)")
    gross = F.when(v == 5, F.col("net")).when(v == 4, F.col("net") + F.col("tax") - 100).otherwise(F.col("net") + F.col("tax")).cast("decimal(18,2)")
    gap = F.when(v == 1, "\n").otherwise(" ")
    money = lambda a: F.concat(gap, written(a, european), F.lit(" DH"))
    tax_lines = (
        F.when(v == 5, F.lit(None).cast("string"))
        .when(v == 7, F.concat(F.lit("TVA 20 % :"), money(half), F.lit("\nTVA 14 % :"), money((F.col("tax") - half).cast("decimal(18,2)"))))
        .otherwise(F.concat(F.lit("TVA 20 % :"), money(F.col("tax"))))
    )
    text = F.concat_ws(
        "\n", F.concat(F.lit("Société "), "customer_name"), F.concat(F.lit("ICE : "), F.lpad(F.col("customer").cast("string"), 15, "0")), F.lit("FACTURE"),
        F.concat(F.lit("N° : FA-"), F.col("doc_id").cast("string")),
        F.concat(F.when(v == 1, "Date de facture : ").otherwise("Date : "), F.date_format("issued", "dd/MM/"), F.when(v == 6, F.date_format("issued", "yy")).otherwise(F.date_format("issued", "yyyy"))),
        F.concat(F.when(v == 3, "T0taI HT :").otherwise("Total HT :"), money(F.col("net"))), tax_lines,
        F.concat(F.when(v == 5, "Net à payer :").when(v == 3, "Tota1 TTC :").otherwise("Total TTC :"), money(gross)),
    )
    # a few numbers stand for a document that takes long to read, so they are not gathered into few tasks by their bytes
    facts = invoice_facts(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "variant")
    return facts.select("doc_id", F.concat(F.lit("scan_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("source"), text.alias("text"))


#: The same facts in SQL: net, tax and gross straight from the relational columns.
FACTS_SQL = """
n AS (SELECT l_orderkey, sum(round(l_extendedprice, 2)::DECIMAL(18,2))::DECIMAL(18,2) AS net FROM lineitem GROUP BY l_orderkey),
f AS (SELECT o_orderkey AS doc_id, c_custkey AS customer, c_name AS customer_name, o_orderdate::DATE AS issued, net, round(net * 0.20::DECIMAL(3,2), 2)::DECIMAL(18,2) AS tax, (o_orderkey % 8)::INT AS variant
      FROM orders JOIN n ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey)
"""
