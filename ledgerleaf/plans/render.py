"""Synthetic documents rendered from order tables: texts whose right extraction is known from the tables.

Amounts are printed in the Spanish form (comma as the point).  One aggregation
by order gathers its lines, which are few; everything else is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARKERS = {"mercadona": "MERCADONA S.A.", "miller": "LENCAR CANARIAS", "empark": "EMPARK APARCAMIENTOS", "acastimar": "ACASTIMAR, S.L.", "doctoragua": "www.doctoragua.es"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str = "key") -> DataFrame:
    """Deal few large files, or partitions that were merged for their small bytes, over all cores: rules cost CPU, not bytes."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def number(c: Column, digits: int) -> Column:
    return F.replace(c.cast(f"decimal(18,{digits})").cast("string"), F.lit("."), F.lit(","))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, key, number, date, subtotal, tax, total, name`` of each order: what its documents say.

    The total is the order's price, the tax seven per cent of it, down to cents.
    """
    total = F.col("o_totalprice").cast("decimal(12,2)")
    tax = (F.floor(total * 7) / 100).cast("decimal(12,2)")
    return spread(load(spark, sf_dir, "orders"), "o_orderkey").select(
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("file"),
        F.col("o_orderkey").alias("key"),
        F.concat(F.lpad(F.col("o_orderkey").cast("string"), 4, "0"), F.lit("/"), F.date_format("o_orderdate", "yy")).alias("number"),
        F.to_date("o_orderdate").alias("date"),
        (total - tax).cast("decimal(12,2)").alias("subtotal"),
        tax.alias("tax"),
        total.alias("total"),
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, lines`` of each order with lines, in the order of the four key columns."""
    part = load(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("name"), F.col("p_retailprice").cast("decimal(18,4)").alias("price"))
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("units"), F.col("l_extendedprice").cast("decimal(18,4)").alias("amount"), F.round(F.col("l_discount") * 100).cast("int").alias("discount"), F.round(F.col("l_tax") * 100).cast("int").alias("rate"))
    # Dealt by the order's key as the orders are, and so neither again for the aggregation nor for the join with them.
    j = spread(li.join(part, F.col("l_partkey") == F.col("p_partkey")), "l_orderkey")
    return j.groupBy(F.col("l_orderkey").alias("key")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "name", "units", "price", "amount", "discount", "rate"))).alias("lines"))


def with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines; an order without lines has an empty list."""
    lines = order_lines(spark, sf_dir)
    docs = orders(spark, sf_dir).join(lines.hint("merge"), "key", "left").withColumn("lines", F.coalesce("lines", F.filter(F.array(F.lit(None).cast(lines.schema["lines"].dataType.elementType)), lambda x: x.isNotNull())))
    return docs


def _rows(line) -> Column:
    return F.array_join(F.transform("lines", line), "\n")


def ticket(docs: DataFrame) -> Column:
    """A tabular ticket with seven columns."""
    line = lambda x: F.concat_ws(" ", x["name"], x["units"].cast("string"), number(x["price"], 4), number(x["amount"], 4), F.when(x["rate"] == 0, F.lit("EX")).otherwise(F.concat(x["rate"].cast("string"), F.lit("%"))), number(F.lit(0), 4), number(x["amount"], 4))
    return F.concat(F.lit(MARKERS["mercadona"] + "\nDescripción Unid. P.Unitario B.Imp. IGIC Cuota IGIC Importe\n"), _rows(line), F.lit("\nTotal Factura "), number(F.col("total"), 2))


def miller(docs: DataFrame, lines: bool = True) -> Column:
    line = lambda x: F.concat(x["name"], F.lit(" MÓDULO Nº : A"), x["l_linenumber"].cast("string"), F.lit(" "), x["units"].cast("string"), F.lit(" "), number(x["price"], 2), F.lit(" "), number(x["amount"], 2), F.lit(" "), number(x["rate"], 2))
    n = F.concat(F.lit("F"), F.lpad((F.col("key") % 10000).cast("string"), 4, "0"), F.lit("/"), F.date_format("date", "yy"))
    return F.concat(
        F.lit("Fecha de factura: "), F.date_format("date", "dd/MM/yyyy"), F.lit(f"\n{MARKERS['miller']} "), n, F.lit("\nRefª. Descripción Uds. Precio ud. Importe IGIC\nTeléfono : 600000000 \n"),
        _rows(line) if lines else F.lit(""), F.lit("\nRecibo Resumen\nBase imponible Importe IGIC Total Factura "), number(F.col("subtotal"), 2), F.lit(" "), number(F.col("tax"), 2), F.lit(" "), number(F.col("total"), 2),
    )


def empark(docs: DataFrame, lines: bool = True) -> Column:
    line = lambda x: F.concat(x["name"], F.lit(" "), x["units"].cast("string"), F.lit(" "), number(x["price"], 2), F.lit(" "), number(x["amount"], 2), F.lit(" "), number(x["rate"], 2), F.lit(" %"))
    return F.concat(
        F.lit(f"{MARKERS['empark']}\nFACTURA Nº L"), F.col("number"), F.lit("\nFecha de Emisión "), F.date_format("date", "yyyy-MM-dd"), F.lit("\nDetalle de Facturación\n"),
        _rows(line) if lines else F.lit(""), F.lit("\nDetalle del IGIC\nTOTAL Líquido "), number(F.col("subtotal"), 2), F.lit(" € TOTAL IGIC "), number(F.col("tax"), 2), F.lit(" € TOTAL "), number(F.col("total"), 2), F.lit(" €"),
    )


def acastimar(docs: DataFrame, lines: bool = True) -> Column:
    line = lambda x: F.concat(x["name"], F.lit(" "), number(x["price"], 2), F.lit(" "), number(x["price"], 2), F.lit(" "), number(x["discount"], 2), F.lit(" AB."), x["l_partkey"].cast("string"), F.lit(" "), number(x["amount"], 2), F.lit(" "), number(x["units"], 2))
    n = F.concat(F.date_format("date", "yy"), F.lit("-"), F.lpad((F.col("key") % 10000).cast("string"), 4, "0"))
    return F.concat(
        F.lit(f"{MARKERS['acastimar']} FACTURA VENTA "), n, F.lit("\nFecha operación: "), F.date_format("date", "dd-MM-yyyy"), F.lit("\nPrecio Unitario "),
        _rows(line) if lines else F.lit(""), F.lit("\nImporte neto BaseIVA "), number(F.col("total"), 2), F.lit(" "), number(F.col("total"), 2),
    )


def doctoragua(docs: DataFrame) -> Column:
    return F.concat(F.lit(f"{MARKERS['doctoragua']}\nFACTURA #"), F.lpad(F.col("key").cast("string"), 5, "0"), F.lit(" Fecha "), F.date_format("date", "dd/MM/yyyy"), F.lit("\nBASE IMPONIBLE "), number(F.col("subtotal"), 2), F.lit(" IMPUESTO "), number(F.col("tax"), 2), F.lit(" IVA\nTOTAL "), number(F.col("total"), 2))


def generic(docs: DataFrame, date: Column | None = None, total: Column | None = None) -> Column:
    """A document with plain labels and no vendor."""
    date = date if date is not None else F.date_format("date", "d/M/yyyy")
    total = total if total is not None else number(F.col("total"), 2)
    return F.concat(
        F.lit("Nº Factura: F-"), F.col("key").cast("string"), F.lit("\nFecha Factura:\n"), date, F.lit("\r\nFecha factura simplificada: "), date, F.lit("\nSubtotal: "), number(F.col("subtotal"), 2), F.lit(" EUR\nIGIC (7%): "), number(F.col("tax"), 2), F.lit(" EUR\nImporte total: "), total, F.lit(" €\n"),
    )
