"""The driver's tables in the shapes of the reference's inputs, and hand-written edge cases.

The tables hold no Cyrillic, no-break spaces, fences or keys, so every text query also runs over EDGES.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.plans import duck, specs

EDGES = [
    "", " ", " - ", "-ll-", "l", "ll", "L", "II", ".", "/", "3,6", "------", "-------", "— // —", "«»", "\"", "''", "·", "‐‑", "-u_", "— и —", "-k-", "-abc-",
    "Описание разреза", "объём породы", "Объем", "Геолог Иванов", "буровой мастер", "подпись", "дата контроля", "олово", "АБВГ", "ё", "Ёлка", "елка 12,5", "12", "1)", "(2).", "²", "10 000", "1 2 3 4",
    "12,5 м", "3.14.15", "№ 7", "x12", "nc", "nс", "Нз", "H3", " h 3 ", "cл.", "6/o", "b/o", "6о", "nэ", "нэ", "zz", ">>", "—''—", "—«—", "a  b\tc", "two  spaces", "Api-Key AbC.12-x end", "api-key  q_9", "AQVNabcdefghij1234", "sk-or-abcdef.123456", "AQVNshort",
    "Скважина № 12", "глубина 4,5", "самородки: размер и окатанность", "показатели на пласт на массу", "Контроль: что контролируется, вес металла", "Подсчёт: наименование показателей, пласт", "опробование: процент, содержание", "abc DEF abc", "Ab-c", "aіb", "іі", "x y",
]
REPLIES = ['{"a": 1}', '```json\n{"a": [1, 2]}\n```', "```\n{\"k\": null}\n```", 'Here: {"a": {"b": 2}} done', "{broken", "no json", "", "  ", '[1, 2]', 'x {"a": 1} y }', "null", '{"a": "}"}']
BOUNDS = (0, 15, 38, 62, 86, 207, 239, 266, 300)
TOL = 6 * 3600 * 1_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(c: str) -> F.Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")


def words(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("table_id"), F.col("event_id").alias("word_id"), micros("ts").alias("y"), F.col("value").alias("cx"), F.col("event_type").alias("text"))


WORDS = "words AS (SELECT user_id AS table_id, event_id AS word_id, epoch_us(ts) AS y, value AS cx, event_type AS text FROM events)"


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(-1, i, t) for i, t in enumerate(EDGES)], "doc_id long, r int, line string")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("r", "line")).unionByName(edges(spark))


LINES = (
    "lines AS (SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10)))))::INTEGER AS r, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents"
    " UNION ALL SELECT * FROM " + duck.values([(-1, i, t) for i, t in enumerate(EDGES)], "e(doc_id, r, line)") + ")"
)


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct words with their numbers."""
    split = lines(spark, sf).select(F.explode(F.split("line", " ")).alias("word"))
    return split.unionByName(edges(spark).select(F.col("line").alias("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


TOKENS = LINES + ", tokens AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(line, ' ')) AS word FROM lines UNION ALL SELECT line FROM lines WHERE doc_id = -1) GROUP BY word)"


def engines(spark: SparkSession, sf: str) -> DataFrame:
    """(table_id, r, c, q, y, y_conf, ink) of two engines' readings; some are blank, repeat marks, codes or numbers."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    r = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1).cast("int")
    p = F.col("o_orderpriority")
    q = F.when(k % 7 == 0, F.lit("-ll-")).when(k % 7 == 1, F.lit("")).when(k % 13 == 2, F.lit("H3")).otherwise(p)
    y = F.when(k % 5 == 0, p).when(k % 5 == 1, F.lower(p)).when(k % 5 == 2, F.substring(p, 1, 4)).when(k % 5 == 3, F.lit("")).when(k % 3 == 0, F.lit("-u_")).otherwise(F.lit("nc"))
    return o.select(F.col("o_custkey").alias("table_id"), r.alias("r"), (k % 4).cast("int").alias("c"), q.alias("q"), y.alias("y"), ((k % 100) / 100).alias("y_conf"), (k % 11 != 0).alias("ink"))


ENGINES = """engines AS (
  SELECT o_custkey AS table_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS r, CAST(o_orderkey % 4 AS INTEGER) AS c,
         CASE WHEN o_orderkey % 7 = 0 THEN '-ll-' WHEN o_orderkey % 7 = 1 THEN '' WHEN o_orderkey % 13 = 2 THEN 'H3' ELSE o_orderpriority END AS q,
         CASE o_orderkey % 5 WHEN 0 THEN o_orderpriority WHEN 1 THEN lower(o_orderpriority) WHEN 2 THEN substring(o_orderpriority, 1, 4) WHEN 3 THEN ''
              ELSE CASE WHEN o_orderkey % 3 = 0 THEN '-u_' ELSE 'nc' END END AS y,
         (o_orderkey % 100) / 100 AS y_conf, o_orderkey % 11 <> 0 AS ink
  FROM orders)"""


def marked(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem's returnflag down each order, with repeats as marks: (table_id, r, text, truth)."""
    li = table(spark, sf, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    w = Window.partitionBy("l_orderkey").orderBy(*order)
    at = li.withColumns({"r": (F.row_number().over(w) - 1).cast("int"), "before": F.lag("l_returnflag").over(w)})
    text = F.when(F.col("before") == F.col("l_returnflag"), F.lit("-ll-")).when(F.col("l_quantity") % 9 == 0, F.lit("")).otherwise(F.col("l_returnflag"))
    return at.select(F.col("l_orderkey").alias("table_id"), "r", F.when(F.col("l_linenumber") % 2 == 0, F.lit(0)).otherwise(F.lit(1)).alias("c"), text.alias("text"), F.col("l_returnflag").alias("truth"), F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax"))


MARKED = """numbered AS (
  SELECT *, CAST(row_number() OVER w - 1 AS INTEGER) AS r, lag(l_returnflag) OVER w AS before FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus)
), marked AS (
  SELECT l_orderkey AS table_id, r, CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 1 END AS c,
         CASE WHEN before = l_returnflag THEN '-ll-' WHEN l_quantity % 9 = 0 THEN '' ELSE l_returnflag END AS text, l_returnflag AS truth, l_extendedprice AS price, l_tax AS tax
  FROM numbered)"""


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as gray tiles of 8 by 8 with values 0 to 255."""
    t = F.transform("embedding", lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(v.cast("double") * 64 + 128))).cast("int"))
    return table(spark, sf, "embeddings").select("vec_id", t.alias("tile"))


TILES = "tiles AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(least(255, greatest(0, floor(CAST(v AS DOUBLE) * 64 + 128))) AS INTEGER)) AS tile FROM embeddings)"


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Synthetic boxes on half pages, from pages."""
    p, k = table(spark, sf, "pages"), F.col("page_id")
    return p.select(k.alias("page_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("b")).select(
        "page_id", "b", F.when(k % 2 == 0, F.lit("L")).otherwise(F.lit("R")).alias("side"), F.lit(1000).alias("width"), F.lit(1400).alias("height"),
        ((k * 37 + F.col("b") * 211) % 300).cast("int").alias("x"), ((k * 53 + F.col("b") * 131) % 700).cast("int").alias("y"),
        ((k * 71 + F.col("b") * 389) % 650 + 40).cast("int").alias("w"), ((k * 29 + F.col("b") * 617) % 1100 + 20).cast("int").alias("h"), ((k + F.col("b") * 3) % 9).cast("int").alias("v_rules"),
    )


BOXES = """boxes AS (
  SELECT page_id, b, CASE WHEN page_id % 2 = 0 THEN 'L' ELSE 'R' END AS side, 1000 AS width, 1400 AS height,
         CAST((page_id * 37 + b * 211) % 300 AS INTEGER) AS x, CAST((page_id * 53 + b * 131) % 700 AS INTEGER) AS y,
         CAST((page_id * 71 + b * 389) % 650 + 40 AS INTEGER) AS w, CAST((page_id * 29 + b * 617) % 1100 + 20 AS INTEGER) AS h, CAST((page_id + b * 3) % 9 AS INTEGER) AS v_rules
  FROM pages, range(4) AS t(b))"""

KIND_ROWS = [(i, k) for i, k in enumerate(specs.KINDS)]
