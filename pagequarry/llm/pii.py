r"""Personal data, and the terms that give it away, in DataFrame functions only.

Patterns find the base spans: e-mail addresses, IP addresses, payment cards and phone
numbers. Each distinct value is a protected entity. A term in the documents of an entity
discloses it as far as seeing the term makes the entity likelier: over the corpus, the
pointwise mutual information of term and entity, log2(N * near / (with_term * with_entity)),
against what there is to know, the entity's information log2(N / with_entity). A ratio of
1 says that the term occurs nowhere but with the entity. Every occurrence of a term at
``generalise`` or more, in any document, becomes a span of kind ``term``; in sanitised
text it gives way to a general word, and at ``remove`` or more it goes. A pair counts once
it was seen in ``support`` different texts, so that chance and copies of a text don't.

Counts cover all documents and whole texts.

Defined results: a null text counts as empty; a null ``doc_id`` is kept; repeated rows
each give the same row; an empty table gives none; extra columns are ignored, or kept by
:func:`sanitise`. A term that touches a base span is no span of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import text_of, whole_row
from pagequarry.session import stage

#: The base patterns. A match can begin where the last one ended or at the start of a run,
#: and runs aren't given back: the same matches as of the plain patterns, in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
KINDS = ("email", "ip", "card", "phone")
#: A term: a whole run of letters, three at least.
TERM = r"(?<!\p{L})\p{L}{3,}+"
#: What stands for the code points of base spans, and a term that touches none.
MARK = "\uffff"
APART = rf"(?<![\p{{L}}{MARK}])\p{{L}}{{3,}}+(?!{MARK})"
SPAN = "array<struct<start:int,end:int,value:string>>"
TOLD = "array<struct<start:int,end:int,term:string,disclosed:double>>"


def matches(text: Column, pattern: str) -> Column:
    """All matches with their places, as an array of (start, end, value) in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.zip_with(
        found,
        F.slice(gaps, F.lit(1), F.size(found)),
        lambda m, g: F.struct(m.alias("value"), F.char_length(g).alias("gap"), F.char_length(m).alias("length")),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + x["gap"]
        end = begin + x["length"]
        span = F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(span)).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(both, start, step)["out"]).otherwise(F.array().cast(SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether every second digit from the right, doubled, gives a sum divisible by ten."""
    digits = F.transform(F.split(F.reverse(_digits(value)), ""), lambda c: c.cast("int"))
    worth = F.transform(digits, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(F.filter(worth, lambda x: x.isNotNull()), F.lit(0), lambda s, x: s + x) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The base spans of each kind."""
    card = lambda v: F.when(F.length(_digits(v)).between(16, 19), _luhn(v)).otherwise(False)
    return {
        "email": matches(text, EMAIL),
        "ip": F.filter(matches(text, IP), lambda x: x["value"].rlike(rf"^{OCTET}(\.{OCTET}){{3}}$")),
        "card": F.filter(matches(text, CARD), lambda x: card(x["value"])),
        "phone": F.filter(matches(text, PHONE), lambda x: F.length(_digits(x["value"])).between(8, 15)),
    }


def _masked(text: Column, spans: Column) -> Column:
    """``text`` with ``MARK`` for every code point of a span, so places stay."""
    plain = F.translate(text, MARK, " ")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        begin, end = F.greatest(s["at"], x["start"]), F.greatest(s["at"], x["end"])
        out = F.concat(s["out"], F.substring(plain, s["at"] + 1, begin - s["at"]), F.repeat(F.lit(MARK), end - begin))
        return F.struct(end.alias("at"), out.alias("out"))

    places = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    done = F.aggregate(places, start, step)
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substring(plain, done["at"] + 1, F.char_length(plain)))).otherwise(plain)


def _distinct_terms(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower))


def _marked(docs: DataFrame) -> DataFrame:
    """``(doc_id, h, text, spans)``: a row per document with its base spans."""
    text = text_of()
    rows = docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text"))
    rows = rows.withColumns(base_spans(F.col("text")))

    def labelled(kind: str) -> Column:
        return F.transform(
            kind,
            lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")),
        )

    kinds = [labelled(kind) for kind in KINDS]
    return rows.select("doc_id", "h", "text", F.concat(*kinds).alias("spans"))


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, h, spans, terms)``: a row per document with its base spans and, if any, its distinct terms apart from them."""
    rows = _marked(docs)
    terms = F.when(F.size("spans") > 0, _distinct_terms(_masked(F.col("text"), F.col("spans")), APART))
    return rows.select("doc_id", "h", "spans", terms.alias("terms"))


def disclosures(docs: DataFrame, scanned: DataFrame, support: int, threshold: float) -> DataFrame:
    """``(term, entity, disclosed)``: the pairs whose term discloses the entity, and how far."""
    total = float(scanned.count())
    held = scanned.filter(F.size("spans") > 0)
    entity = F.array_distinct(F.transform("spans", _entity))
    # copies of a text are counted, but have the same terms and entities
    texts = held.groupBy("h").agg(F.count("*").alias("copies"), F.first("terms").alias("terms"), F.first(entity).alias("entities"))
    texts = stage(texts, "texts")
    within = texts.select("h", "copies", F.explode("entities").alias("entity"))
    entities = within.groupBy("entity").agg(F.sum("copies").alias("with_entity"), F.count("*").alias("texts"))
    within = within.join(entities.filter(F.col("texts") >= support).drop("texts"), "entity")
    words = _distinct_terms(text_of(), TERM)
    counts = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("with_term"))
    counts = counts.filter(F.col("with_term") >= support)
    # no pair is near more often than its entity occurs, which bounds the terms that can reach the threshold
    bound = F.log2("with_term") <= F.log2(F.lit(total)) - threshold * F.log2(total / F.col("with_entity")) + 1e-9
    terms = texts.select("h", F.explode("terms").alias("term"))
    rarest = within.groupBy("h").agg(F.max("with_entity").alias("with_entity"))
    terms = terms.join(rarest, "h").join(counts, "term").filter(bound).drop("with_entity")
    both = terms.join(within, "h").filter(bound)
    near = both.groupBy("term", "entity", "with_term", "with_entity").agg(F.sum("copies").alias("near"), F.count("*").alias("texts"))
    known = near.filter(F.col("texts") >= support)
    gained = F.log2(F.lit(total) * F.col("near") / (F.col("with_term") * F.col("with_entity")))
    whole = F.log2(F.lit(total) / F.col("with_entity"))
    ratio = F.when(whole > 0, gained / whole).otherwise(F.lit(0.0))
    return known.select("term", "entity", ratio.alias("disclosed")).filter(F.col("disclosed") >= threshold)


def _entity(span: Column) -> Column:
    value = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"], F.lit(":"), value)


def personal_data(docs: DataFrame, support: int = 3, generalise: float = 0.75) -> DataFrame:
    """``(doc_id, h, spans, terms)``: the base spans and the disclosing terms of every document.

    ``spans`` is an array of (kind, start, end, value); ``terms`` of (start, end, term, disclosed).
    """
    telling = disclosures(docs, stage(scan(docs), "scanned"), support, generalise)
    telling = stage(telling.groupBy("term").agg(F.max("disclosed").alias("disclosed")), "telling")
    words = docs.select(F.xxhash64(text_of()).alias("h"), F.explode(_distinct_terms(text_of(), TERM)).alias("term"))
    hits = words.join(telling, "term").distinct().groupBy("h").agg(F.collect_list(F.struct("term", "disclosed")).alias("hits"))
    rows = _marked(docs).join(stage(hits, "hits"), "h", "left")
    rows = rows.withColumns({"hits": F.map_from_entries("hits"), "masked": _masked(F.col("text"), F.col("spans"))})
    return rows.select("doc_id", "h", "spans", F.when(F.col("hits").isNotNull(), _told(F.col("masked"), F.col("hits"))).alias("terms"))


def _told(text: Column, hits: Column) -> Column:
    """Every place of a term in ``hits``, as an array of (start, end, term, disclosed)."""
    found = F.regexp_extract_all(text, F.lit(APART), F.lit(0))
    both = F.arrays_zip(found.alias("value"), F.slice(F.split(text, APART, -1), F.lit(1), F.size(found)).alias("gap"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(TOLD).alias("out"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.char_length(x["gap"])
        end = begin + F.char_length(x["value"])
        term = F.lower(x["value"])
        span = F.struct(begin.alias("start"), end.alias("end"), term.alias("term"), hits[term].alias("disclosed"))
        out = F.when(F.coalesce(F.map_contains_key(hits, term), F.lit(False)), F.concat(s["out"], F.array(span))).otherwise(s["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    return F.aggregate(both, start, step)["out"]


def digests(found: DataFrame) -> DataFrame:
    """Counts and span strings of :func:`personal_data`."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    place = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.transform("spans", place)
    terms = F.coalesce(
        F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"], t["end"])), F.array().cast("array<string>")
    )
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, terms), ",").alias("spans"),
    )


def sanitise(docs: DataFrame, support: int = 3, generalise: float = 0.75, remove: float = 0.95) -> DataFrame:
    """``docs`` with base spans replaced by their kind and disclosing terms generalised or removed."""
    columns = docs.columns
    found = personal_data(docs, support, generalise).dropDuplicates(["doc_id", "h"])
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("by")))
    term = F.transform(
        F.coalesce("terms", F.array().cast(TOLD)),
        lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["disclosed"] >= remove, "").otherwise("[TERM]").alias("by")),
    )
    edits = found.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.sort_array(F.concat(base, term)).alias("_edits"))
    keyed = docs.select("doc_id", "text", F.xxhash64(text_of()).alias("_own"), whole_row(docs, ("text",)).alias("_row"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_h"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        # of spans that overlap, the first gives the word and the last the end
        fresh = F.concat(s["out"], F.substring(text_of(), s["at"] + 1, x["start"] - s["at"]), x["by"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], fresh).otherwise(s["out"]).alias("out"))

    done = F.aggregate("_edits", start, step)
    joined = keyed.join(edits, same, "left").withColumn("_done", done)
    clean = F.concat(F.col("_done.out"), F.substring(text_of(), F.col("_done.at") + 1, F.char_length(text_of())))
    text = F.when(F.size("_edits") > 0, clean).otherwise(F.col("text")).alias("text")
    return joined.select(*[text if c == "text" else F.col(f"_row.`{c}`") for c in columns])
