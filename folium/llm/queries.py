"""The registered query of each operator, over its whole tables, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folium.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folium.llm.lines import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, pos, line, lower_ascii(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS k FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
f AS (SELECT k, min(doc_id) AS first FROM l WHERE len_points(k) >= 10 GROUP BY k HAVING min(doc_id) < max(doc_id)),
m AS (SELECT l.doc_id, l.pos, l.line, f.k IS NOT NULL AND l.doc_id > f.first AS dropped FROM l LEFT JOIN f USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def _lower_ascii(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


OP2_SQL = OP2_SQL.replace("lower_ascii(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))", _lower_ascii("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")).replace("len_points(", "length(")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folium.llm.fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folium.sources.store import scratch
    from folium.llm.tokenstore import digests, write_tokens

    path = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return digests(spark, path)


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as captures, fetched one day after another through two years."""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(date'2023-01-01', cast(page_id % 730 as int))").alias("fetched_on"))


def _url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dated list drawn from the pages: hosts, parent domains and path prefixes that come and go."""
    pages = table(spark, sf_dir, "pages").where("page_id % 3 = 0")
    host = F.regexp_extract("url", "^https?://([^/:?#]+)", 1)
    part = F.regexp_extract("url", "^https?://([^/:?#]+/[^/?#]+)", 1)
    pattern = F.when(F.col("page_id") % 2 == 0, host).when(part != "", part).otherwise(host)
    on = F.expr("date_add(date'2023-01-01', cast((page_id * 37) % 700 as int))")
    off = F.expr("date_add(date'2023-01-01', cast((page_id * 37) % 700 + 40 + page_id % 90 as int))")
    added = pages.select(pattern.alias("pattern"), F.lit("add").alias("action"), on.alias("listed_on"))
    removed = pages.where("page_id % 5 <> 0").select(pattern.alias("pattern"), F.lit("remove").alias("action"), off.alias("listed_on"))
    return added.unionByName(removed)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folium.llm.urlfilter import blocked

    return blocked(_captures(spark, sf_dir), _url_list(spark, sf_dir))


OP5_SQL = r"""
WITH c AS (SELECT page_id, url, CAST(DATE '2023-01-01' + CAST(page_id % 730 AS INT) AS DATE) AS fetched_on FROM pages),
p AS (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS h, regexp_extract(url, '^https?://([^/:?#]+/[^/?#]+)', 1) AS hp FROM pages WHERE page_id % 3 = 0),
l AS (SELECT page_id, CASE WHEN page_id % 2 = 0 OR hp = '' THEN h ELSE hp END AS key FROM p),
e AS (
  SELECT key, 'add' AS action, CAST(DATE '2023-01-01' + CAST((page_id * 37) % 700 AS INT) AS DATE) AS since FROM l UNION ALL
  SELECT key, 'remove', CAST(DATE '2023-01-01' + CAST((page_id * 37) % 700 + 40 + page_id % 90 AS INT) AS DATE) FROM l WHERE page_id % 5 <> 0),
d AS (SELECT lower(split_part(key, '/', 1)) || substr(key, length(split_part(key, '/', 1)) + 1) AS key, since, max(action) AS action FROM e WHERE key <> '' GROUP BY ALL),
i AS (SELECT key, since, action, lead(since) OVER (PARTITION BY key ORDER BY since) AS until FROM d),
u AS (SELECT DISTINCT url, fetched_on, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS h, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM c),
k AS (
  SELECT DISTINCT url, fetched_on, array_to_string(list_slice(string_split(h, '.'), n, len(string_split(h, '.'))), '.') AS key
  FROM u, LATERAL (SELECT unnest(generate_series(1, greatest(len(string_split(h, '.')) - 1, 1))) AS n) UNION
  SELECT DISTINCT url, fetched_on, h || '/' || array_to_string(list_slice(s, 1, n), '/')
  FROM (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM u) v, LATERAL (SELECT unnest(generate_series(1, len(s))) AS n)),
b AS (
  SELECT k.url, k.fetched_on, i.key AS rule, i.since AS listed_on, row_number() OVER (PARTITION BY k.url, k.fetched_on ORDER BY length(i.key) DESC, i.key DESC) AS r
  FROM k JOIN i ON k.key = i.key AND i.action = 'add' AND k.fetched_on >= i.since AND (i.until IS NULL OR k.fetched_on < i.until))
SELECT c.page_id, c.url, c.fetched_on, b.rule IS NOT NULL AS blocked, b.rule, b.listed_on FROM c LEFT JOIN b ON b.url = c.url AND b.fetched_on = c.fetched_on AND b.r = 1
"""


def op6_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folium.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folium.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folium.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folium.llm.wordpieces import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folium.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))
def _repeated(documents: DataFrame) -> DataFrame:
    """(doc_id, text) where a tenth of the documents, by crc32 of the id, repeat a stretch of theirs from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    split = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    rows = documents.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, split).alias("w"))
    n = F.size("w")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    i = F.sequence(F.lit(0), n - 1)
    again = F.transform(i, lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folium.llm.periodic import collapse

    out = collapse(_repeated(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longer = lambda x, y: F.when(y["length"] * x["period"] > x["length"] * y["period"], y).otherwise(x)  # of equal ones the first
    best = F.when(F.size("runs") > 0, F.reduce("runs", F.get("runs", F.lit(0)), longer))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), sha(listed).alias("runs_sha256"), sha(F.col("text")).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


OP11_SQL = r"""
WITH c AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(length(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i + 1]) AS BIGINT))),
      lambda v, x: list_reduce(list_concat([xor(v, x)], CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END))) AS h
  FROM documents),
g AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM c),
e AS MATERIALIZED (SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(len(w)), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(w) - a) // (3 + g % 8)) END]) END AS w FROM g),
t AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i, len(w) AS n FROM e),
q AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM t x JOIN t y ON y.doc_id = x.doc_id AND y.word = x.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM q),
l AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
r AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM l GROUP BY ALL),
m AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS listed FROM r GROUP BY doc_id),
b AS (SELECT x.* FROM r x WHERE NOT EXISTS (SELECT 1 FROM r y WHERE y.doc_id = x.doc_id AND (y.length * x.period > x.length * y.period OR y.length * x.period = x.length * y.period AND (y.start < x.start OR y.start = x.start AND y.period < x.period)))),
x AS (SELECT DISTINCT t.doc_id, t.i FROM t JOIN r ON t.doc_id = r.doc_id AND t.i >= r.start + r.period AND t.i < r.start + r.length),
k AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.i) AS kept FROM t ANTI JOIN x ON t.doc_id = x.doc_id AND t.i = x.i GROUP BY t.doc_id)
SELECT e.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length, CAST(b.period AS BIGINT) AS period, CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM e LEFT JOIN m ON m.doc_id = e.doc_id LEFT JOIN b ON b.doc_id = e.doc_id LEFT JOIN k ON k.doc_id = e.doc_id
"""



def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folium.llm.language import languages, learn

    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return languages(documents, learn(documents)).drop("stretches")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folium.llm.codes import codes, learn, with_group_error

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    books = learn(vectors)
    out = with_group_error(codes(vectors, books).drop("embedding"))
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return out.select("vec_id", code.alias("code"), "error", F.col("group_error").alias("label_error"), F.sha2(F.lit(books.listed()).cast("binary"), 256).alias("codebooks_sha256"))


def _op13_sql(rounds: int = 4) -> str:
    near = "SELECT vec_id, part, c, min(CAST(xx + bb - 2 * list_dot_product(c, b) AS BIGINT) * 256 + e) AS m FROM p JOIN b{r} USING (part) GROUP BY ALL"
    refit = """SELECT part, e, list(s ORDER BY pos) AS b, list_dot_product(list(s ORDER BY pos), list(s ORDER BY pos)) AS bb FROM (
    SELECT part, m % 256 AS e, pos, floor(sum(c[pos]) / count(*)) AS s FROM a{r}, LATERAL (SELECT unnest(generate_series(1, len(c))) AS pos) GROUP BY ALL) GROUP BY ALL
    UNION ALL SELECT part, e, b, bb FROM b{r} WHERE (part, e) NOT IN (SELECT (part, m % 256) FROM a{r})"""
    steps = "".join(f"a{r} AS MATERIALIZED ({near.format(r=r)}),\nb{r + 1} AS MATERIALIZED ({refit.format(r=r)}),\n" for r in range(rounds))
    return f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT *, list_dot_product(c, c) AS xx FROM (SELECT vec_id, part, list_slice(v, part * (len(v) // 4) + 1, (part + 1) * (len(v) // 4)) AS c FROM k, (SELECT unnest([0, 1, 2, 3]) AS part) t)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, c AS b, xx AS bb FROM p QUALIFY e < 256),
{steps}z AS MATERIALIZED ({near.format(r=rounds)}),
h AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, e, pos)) AS codebooks_sha256 FROM (SELECT part, e, unnest(b) AS x, generate_subscripts(b, 1) AS pos FROM b{rounds})),
c AS (SELECT vec_id, string_agg(lower(printf('%02x', m % 256)), '' ORDER BY part) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM z GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id), h
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_duplicates, op2_line_dedup, op3_fingerprints, op4_token_store, op5_url_filter, op6_contaminated, op7_personal_data, op8_quality, op9_token_counts, op10_packing, op11_periodic_runs, op12_language, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op5_url_filter": OP5_SQL, "op11_periodic_runs": OP11_SQL, "op13_vector_codes": _op13_sql()}
