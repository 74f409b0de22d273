"""Secret scans with corpus-wide ownership frequency, in Spark SQL functions alone.

Every whole text gives the base spans (assignments, access keys, long hex runs) and candidates:
further runs of characters that look random and touch no base span. The hashes of all their values
are counted by distinct repositories and owners over the corpus. A value that many owners or many
repositories hold is a widely copied example; any other is owner-specific. Base spans always stay,
with the counts of both sorts; a candidate becomes a span of kind `live` only if it is owner-specific.

Defined results: a null text is empty and has no spans; a null repository or owner is one of its
own; rows that repeat a doc_id or have none each get their own spans; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandel.llm.common import cut, cut_counted, cut_small, lookup, table
from strandel.llm.exprs import let, matches

# The base patterns as stated.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "live")
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: A value that this many owners, or this many repositories of any owners, hold is a copied example.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 5
MIN_DISTINCT_CHARS = 10


def _kind(found: Column, kind: str, value=lambda m: m) -> Column:
    order = KINDS.index(kind)
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("kind"), s["end"].alias("end"), F.sha2(value(s["value"]), 256).alias("hash")))


def base_spans(text: Column) -> Column:
    """The spans of the three base kinds with the hash of the value each holds."""
    held = lambda m: F.regexp_extract(m, ASSIGN, 2)
    assign = F.filter(matches(text, ASSIGN), lambda s: F.length(held(s["value"])) >= 8)
    access = F.filter(matches(text, ACCESS), lambda s: F.length(s["value"]) >= 16)
    return F.concat(_kind(assign, "assign", held), _kind(access, "access"), _kind(matches(text, HEX), "hex"))


def random_looking(value: Column) -> Column:
    """Letters of both cases and digits, and many different characters."""
    return value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]") & (F.size(F.array_distinct(F.split(value, ""))) >= MIN_DISTINCT_CHARS)


def candidates(docs: DataFrame, repository: Column, owner: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, repository, owner and found (base spans and candidates) of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    more = _kind(F.filter(matches(text, CANDIDATE), lambda s: random_looking(s["value"])), "live")
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), repository.cast("string").alias("repository"), owner.cast("string").alias("owner"), F.concat(let(text, base_spans), more).alias("found"))


def apart(rows: DataFrame) -> DataFrame:
    """row, repository, owner and the span of every base span and of the candidates that touch none; sorted once a text."""
    live = KINDS.index("live")
    spans = rows.select("row", "repository", "owner", F.explode("found").alias("s")).select("row", "repository", "owner", "s.*")
    order = Window.partitionBy("row").orderBy("start", "kind", "end")
    base = lambda c: F.when(F.col("kind") < live, F.col(c))
    before = F.max(base("end")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(base("start")).over(order.rowsBetween(1, Window.unboundedFollowing))
    placed = spans.withColumn("before", before).withColumn("after", after)
    free = (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))
    return placed.filter((F.col("kind") < live) | free).drop("before", "after")


def ownership(held: DataFrame) -> DataFrame:
    """hash, n_spans, n_repositories, n_owners over the corpus; each step combines before it shuffles."""
    by_repo = held.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_spans"), F.sum("repos").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))


def scan(docs: DataFrame, repository: Column, owner: Column, copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES, **columns: str) -> DataFrame:
    """doc_id and spans (start, kind, end, hash, n_repositories, n_owners, copied) of every row, in order: base and live ones."""
    rows = cut(candidates(docs, repository, owner, **columns))
    held = cut_small(apart(rows))
    copied = (F.col("n_owners") >= copied_owners) | (F.col("n_repositories") >= copied_repositories)
    owned, n = cut_counted(ownership(held).withColumn("copied", copied))
    known = lookup(held, owned, n, ["hash"], F.col("row"), "inner").filter(~F.col("copied") | (F.col("kind") < KINDS.index("live")))
    fields = ["start", "kind", "end", "hash", "n_repositories", "n_owners", "copied"]
    by_row = known.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,hash:string,n_repositories:bigint,n_owners:bigint,copied:boolean>>")
    return rows.select("row", "doc_id").join(by_row, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns, how many live spans and copied examples there are, and repositories:owners of each span."""
    live = KINDS.index("live")
    n = lambda rule, name: F.size(F.filter("spans", rule)).cast("long").alias(name)
    of = lambda k: lambda s: s["kind"] == k
    counts = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["n_repositories"].cast("string"), s["n_owners"].cast("string"))), ",").alias("held_by")
    return found.select("doc_id", *[n(of(k), f"n_{kind}") for k, kind in enumerate(KINDS)], F.sha2(_joined(F.filter("spans", lambda s: s["kind"] < live)), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), n(lambda s: s["copied"], "n_copied_examples"), counts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digest(scan(docs, F.concat_ws("/", "source", "lang"), F.col("source")))


_SQL_ASSIGN = ASSIGN.replace("'", "''")
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, chr(0)) AS owner, concat_ws('/', source, lang) AS repo FROM documents),
m AS (
  SELECT doc_id, owner, repo, 0 AS kind, regexp_extract_all(t, '{_SQL_ASSIGN}', 0) AS f, string_split_regex(t, '{_SQL_ASSIGN}') AS p FROM d
  UNION ALL SELECT doc_id, owner, repo, 1, regexp_extract_all(t, '{ACCESS}', 0), string_split_regex(t, '{ACCESS}') FROM d
  UNION ALL SELECT doc_id, owner, repo, 2, regexp_extract_all(t, '{HEX}', 0), string_split_regex(t, '{HEX}') FROM d
  UNION ALL SELECT doc_id, owner, repo, 3, regexp_extract_all(t, '{CANDIDATE}', 0), string_split_regex(t, '{CANDIDATE}') FROM d
), x AS (SELECT doc_id, owner, repo, kind, f, p, unnest(f) AS v, generate_subscripts(f, 1) AS k FROM m WHERE len(f) > 0),
y AS (
  SELECT doc_id, owner, repo, kind, v, CASE WHEN kind = 0 THEN regexp_extract(v, '{_SQL_ASSIGN}', 2) ELSE v END AS held,
         CAST(list_sum(list_transform(p[1:k], lambda z: length(z))) + coalesce(list_sum(list_transform(f[1:k - 1], lambda z: length(z))), 0) AS BIGINT) AS s FROM x
), b AS (SELECT * FROM y WHERE kind = 0 AND length(held) >= 8 OR kind = 1 AND length(v) >= 16 OR kind = 2),
c AS (
  SELECT * FROM y WHERE kind = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND len(list_distinct(string_split(v, ''))) >= {MIN_DISTINCT_CHARS}
    AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = y.doc_id AND b.s < y.s + length(y.v) AND y.s < b.s + length(b.v))
), o AS (SELECT held, count(DISTINCT owner) AS n_owners, count(DISTINCT owner || chr(1) || repo) AS n_repos FROM (SELECT held, owner, repo FROM b UNION SELECT held, owner, repo FROM c) GROUP BY held),
a AS (SELECT *, n_owners >= {COPIED_OWNERS} OR n_repos >= {COPIED_REPOSITORIES} AS copied FROM (SELECT * FROM b UNION ALL SELECT * FROM c) JOIN o USING (held)),
n AS (SELECT *, ['assign', 'access', 'hex', 'live'][kind + 1] || ':' || s || ':' || (s + length(v)) AS span FROM a WHERE kind < 3 OR NOT copied)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY s, kind) FILTER (WHERE kind < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY s, kind), '') AS spans,
       count(*) FILTER (WHERE kind = 3) AS n_live, count(*) FILTER (WHERE kind < 3 AND copied) AS n_copied_examples, coalesce(string_agg(n_repos || ':' || n_owners, ',' ORDER BY s, kind), '') AS held_by
FROM d LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
