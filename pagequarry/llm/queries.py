"""The corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import bpe, chat, divergence, hnsw, langid, linedup, mixing, packing, pii, repair, simhash, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS draw
  FROM documents),
per AS (
  SELECT source, sum(size)::DOUBLE AS source_size, 3.0 * sum(size)::DOUBLE AS most,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per),
fits AS (SELECT max(level) AS level FROM levels WHERE level * weight <= most),
goals AS (
  SELECT source, source_size, weight,
         CASE WHEN f.level IS NULL OR f.level * weight > most THEN most ELSE f.level * weight END AS target
  FROM levels, fits f),
placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY draw, size, hash(doc_id)
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS off
  FROM sized),
-- weights against time: from 1.5 falling to 0.5; 1 all along; from 0.25 rising by 1.5 a unit of time
copies AS (
  SELECT p.*, g.source_size, g.target, g.weight, pass, (pass * g.source_size + off + size / 2.0) / g.target AS share
  FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source, range(3) AS passes(pass)),
timed AS (
  SELECT *, CASE weight
      WHEN 5 THEN 2 * share / (1.5 + sqrt(greatest(0, 1.5 * 1.5 - 2 * share)))
      WHEN 2 THEN 2 * share / (1 + sqrt(1))
      ELSE CASE WHEN share <= 0.3125 THEN 2 * share / (0.25 + sqrt(greatest(0, 0.0625 + 3 * share)))
           ELSE 0.5 + 2 * (share - 0.3125) / (1 + sqrt(greatest(0, 1 + 3 * (share - 0.3125)))) END END AS t
  FROM copies),
asked AS (SELECT *, size > 0 AND target > 0 AND share < 1 AND t < 1 AS taken FROM timed),
read AS (
  SELECT *, row_number() OVER (ORDER BY floor(t * 1000000000), source NULLS LAST, draw, size, hash(doc_id), pass) - 1 AS place
  FROM asked WHERE taken)
SELECT a.doc_id, any_value(a.size) AS size, any_value(a.source_size)::BIGINT AS source_size, any_value(a.target) AS target,
       (any_value(a.size) * count(r.place))::BIGINT AS taken, floor(min(r.t) * 1000000000)::BIGINT AS first_at,
       floor(max(r.t) * 1000000000)::BIGINT AS last_at, min(r.place)::BIGINT AS first_place
FROM asked a LEFT JOIN read r ON r.doc_id = a.doc_id AND r.pass = a.pass GROUP BY a.doc_id
"""


@_query(MIX_SQL)
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1 with targets up to three times a source."""
    mixed = mixing.training_places(mixing.mix(_table(spark, sf_dir, "documents")))
    return mixed.select(
        "doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "first_at", "last_at", "first_place"
    )


@_query()
def op1_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    near = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: The conversation whose texts look like marks of the template.
ODD_TURN = "\\### Assistant: </turn> ok"

CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS total,
         15 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g'))
            + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) - 1 AS chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS so_far FROM sized)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(so_far) FILTER (role = 'assistant' OR n = total)::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""


@_query(CHAT_SQL)
def op2_chat_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as prefix-target examples, read back."""
    odd = [(-7, 0, "user", ODD_TURN), (-7, 1, "assistant", ODD_TURN)]
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")
    return chat.digests(chat.examples(rows.union(added)))


@_query()
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the multilingual rank file, and the bytes they decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


LINE_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
everything AS (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS line_no, unnest(parts) AS line FROM docs),
counted AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM everything),
lines AS (
  SELECT *, row_number() OVER w AS idx, sum(words) OVER w AS upto
  FROM counted WHERE words > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
enough AS (
  SELECT s.doc_id, s.idx AS i, e.idx AS j FROM lines s JOIN lines e
  ON s.doc_id = e.doc_id AND e.idx >= s.idx AND e.idx < s.idx + 50 AND e.upto - s.upto + s.words >= 50),
blocks AS (
  SELECT doc_id, i, min(j) AS j FROM enough GROUP BY doc_id, i
  UNION SELECT doc_id, max(i) AS i, j FROM enough GROUP BY doc_id, j),
content AS (
  SELECT b.doc_id, i, min(line_no) AS lo, max(line_no) AS hi, string_agg(line, chr(10) ORDER BY idx) AS run
  FROM blocks b JOIN lines l ON l.doc_id = b.doc_id AND l.idx BETWEEN i AND j GROUP BY b.doc_id, i, j),
copies AS (SELECT * FROM content QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1),
gone AS (
  SELECT DISTINCT e.doc_id, e.line_no FROM everything e JOIN copies c
  ON e.doc_id = c.doc_id AND e.line_no BETWEEN c.lo AND c.hi)
SELECT e.doc_id, count(*)::BIGINT AS n_lines, count(g.doc_id)::BIGINT AS n_deleted,
       coalesce(string_agg(e.line, chr(10) ORDER BY e.line_no) FILTER (g.doc_id IS NULL), '') AS text
FROM everything e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.line_no = g.line_no GROUP BY e.doc_id
"""


@_query(LINE_SQL)
def op10_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the line runs of 50 words or more that occur earlier in the corpus."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = linedup.drop_repeats(docs)
    return cleaned.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_deleted").alias("n_deleted"), "text")


@_query()
def op9_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, and the terms that disclose it."""
    return pii.digests(pii.personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text")))


@_query()
def op7_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labelled rows of two folds."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    learns = toxicity.learn_fold()
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels"), learns)
    scored = docs.select("doc_id", toxicity.tagger(model)(F.col("text")).alias("tagged"))
    return scored.select(
        "doc_id",
        F.coalesce(~learns, F.lit(False)).alias("held_out"),
        F.col("tagged.score").alias("score"),
        (F.col("tagged.score") >= toxicity.REJECT).cast("int").alias("predicted"),
        "tagged.starts",
        "tagged.ends",
    )


@_query()
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from three of four folds."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learns = langid.learn_fold()
    found = langid.identify(docs, langid.learn(docs, learns))
    return found.select("doc_id", F.coalesce(~learns, F.lit(False)).alias("held_out"), "lang_pred", "score")


TOPK_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
"""


@_query(TOPK_SQL)
def op5_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best integer inner products of every twentieth vector, exactly."""
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@_query()
def op8_hnsw_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth vector."""
    return hnsw.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


REPAIR_SQL = r"""
WITH RECURSIVE drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(
           list_concat([4294967295::BIGINT], list_transform(
             string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
           lambda crc, b: list_reduce(list_concat([xor(crc, b)], list_transform(range(8), lambda z: z::BIGINT)),
             lambda x, z: CASE WHEN x & 1 = 1 THEN xor(3988292384::BIGINT, x >> 1) ELSE x >> 1 END)),
         4294967295::BIGINT) % 20 AS draw
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM drawn, unnest(range(CASE WHEN draw = 0 THEN 0 WHEN draw = 3 THEN 2 ELSE 1 END)) AS copies(n)),
alike AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM damaged),
seen AS (
  SELECT *, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS i
  FROM alike),
faults AS (
  SELECT *, left(role, 1) AS ini,
         CASE WHEN solid = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
  FROM seen),
pairs AS (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM faults),
counted AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM pairs GROUP BY conv_id),
best AS (
  SELECT conv_id, n + 1 AS i, {'c': 0, 'a': '', 'o': ''} AS b0,
         {'c': 6, 'a': 'II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'} AS b1,
         {'c': 3, 'a': 'I', 'o': chr(10) || 'assistant:'} AS b2, {'c': 0, 'a': '', 'o': ''} AS b3
  FROM counted
  UNION ALL
  SELECT conv_id, i,
         list_min([z0, {'c': z2.c + 3, 'a': 'I' || z2.a, 'o': chr(10) || 'user:' || z2.o}]),
         list_min([z1, {'c': z2.c + 3, 'a': 'I' || z2.a, 'o': chr(10) || 'user:' || z2.o}]),
         list_min([z2, {'c': z3.c + 3, 'a': 'I' || z3.a, 'o': chr(10) || 'assistant:' || z3.o}]),
         list_min([z3, {'c': z2.c + 3, 'a': 'I' || z2.a, 'o': chr(10) || 'user:' || z2.o}])
  FROM (
    SELECT conv_id, i, y0 AS z0, y1 AS z1,
           list_min([y2, {'c': y3.c + 3, 'a': 'I' || y3.a, 'o': chr(10) || 'assistant:' || y3.o}]) AS z2,
           list_min([y3, {'c': y2.c + 3, 'a': 'I' || y2.a, 'o': chr(10) || 'user:' || y2.o}]) AS z3
    FROM (
      SELECT conv_id, i,
             list_min([d0, CASE WHEN ini = 's' THEN k1 WHEN ini = 'u' THEN k2 END, r2]) AS y0,
             list_min([d1, CASE WHEN ini = 'u' THEN k2 END, r2]) AS y1,
             list_min([d2, CASE WHEN ini = 'a' THEN k3 END, r3]) AS y2,
             list_min([d3, CASE WHEN ini = 'u' THEN k2 END, r2]) AS y3
      FROM (
        SELECT f.conv_id, f.i, ini,
               {'c': b0.c + 4, 'a': 'D' || b0.a, 'o': b0.o} AS d0, {'c': b1.c + 4, 'a': 'D' || b1.a, 'o': b1.o} AS d1,
               {'c': b2.c + 4, 'a': 'D' || b2.a, 'o': b2.o} AS d2, {'c': b3.c + 4, 'a': 'D' || b3.a, 'o': b3.o} AS d3,
               CASE WHEN fault NOT IN ('b', 'd') THEN {'c': b1.c + more, 'a': 'K' || b1.a, 'o': chr(10) || role || ':' || text || b1.o} END AS k1,
               CASE WHEN fault NOT IN ('b', 'd') THEN {'c': b2.c + more, 'a': 'K' || b2.a, 'o': chr(10) || role || ':' || text || b2.o} END AS k2,
               CASE WHEN fault NOT IN ('b', 'd') THEN {'c': b3.c + more, 'a': 'K' || b3.a, 'o': chr(10) || role || ':' || text || b3.o} END AS k3,
               CASE WHEN fault NOT IN ('b', 'd') THEN {'c': b2.c + more + 3, 'a': 'R' || b2.a, 'o': chr(10) || 'user:' || text || b2.o} END AS r2,
               CASE WHEN fault NOT IN ('b', 'd') THEN {'c': b3.c + more + 3, 'a': 'R' || b3.a, 'o': chr(10) || 'assistant:' || text || b3.o} END AS r3
        FROM best b JOIN (SELECT *, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS more FROM faults) f
        ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i - 1))))
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b0.c, 0)::BIGINT AS cost, coalesce(b0.a, '') AS audit,
       sha256(substr(coalesce(b0.o, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.i = 1
"""


@_query(REPAIR_SQL)
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of every conversation, damaged first."""
    return repair.report(repair.damage(_table(spark, sf_dir, "conversations")))


AUDIT_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
tokens AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM tokens GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counted AS (SELECT lang, source, term, count(*) AS n FROM tokens JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS total FROM counted GROUP BY lang, source),
own AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0)::HUGEINT + s.v) AS p
  FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang)
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (sum(sum(n)) OVER (PARTITION BY lang)::HUGEINT + any_value(s.v)) AS q
  FROM own JOIN sizes s USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN own x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN own y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL),
terms AS (
  SELECT o.lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value
  FROM own o JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER w)::INT AS rank
FROM (FROM pairs UNION ALL FROM terms)
WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR rank <= 200
"""


@_query(AUDIT_SQL)
def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ, and the terms that tell each source."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


@_query()
def op12_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, and its place in a sequence of at most 4096 tokens."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
