"""Personal data by pattern and by information content, in DataFrame
operations only.

Patterns find the protected entities: e-mail and IP addresses, card and phone
numbers. A mention is one of its value, of a class of values (the mail domain,
the network, the issuer, the dialling code) and of its kind. Words around their mentions may give an entity away as well. Over the
whole corpus, a term t discloses an entity e when the entity is likely where
the term stands, P(e | t), and far likelier than elsewhere, log2 of
P(e | t) / P(e) bits. Terms over both thresholds, seen in enough different
contexts, are generalised, or removed when they all but name the entity.

The patterns are written so that they never go back over what they have read:
a run of a hundred thousand digits costs no more than so many letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
TERM = "term"

#: Words to each side of a mention that are its context, from so many characters.
CONTEXT_WORDS, CONTEXT_CHARS = 5, 80
#: Different contexts that a term must share with an entity; letters of a term.
SUPPORT, TERM_LETTERS = 3, 4
#: P(e | t) and bits from which a term is generalised; P(e | t) from which it is removed.
LIKELY, BITS, CERTAIN = 0.5, 6.0, 0.95
#: Leading digits of a card's issuer and of a phone number's dialling code.
ISSUER, DIALLING = 4, 3

_LOCAL = "[A-Za-z0-9._%+-]"
#: Each finds what the plain pattern in the comment finds, leftmost and without overlap.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ : a match can only begin where a run of the local part does, or a match ended
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ ; one digit alone is dropped with the other short ones
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    from_right = F.transform(F.split(F.reverse(number), ""), lambda c: F.ascii(c) - 48)
    doubled = F.transform(from_right, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    number = digits(value)
    if kind == "card":
        return F.length(number).between(13, 19) & luhn(number)
    return F.length(number).between(9, 15)


def spans_of(text: Column, kind: str) -> Column:
    """Array of (start, end, value) of one kind, in code points."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    found = F.when(text.contains("@"), found).otherwise(F.array().cast("array<string>")) if kind == "email" else found
    return found


def located(text: Column, kind: str, found: Column) -> Column:
    """found, the matches in order, with their places: the parts between them
    and the matches alternate."""
    parts = F.split(text, PATTERNS[kind], -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["part"])
        end = begin + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    pairs = F.zip_with(F.slice(parts, F.lit(1), F.size(found)), found, lambda p, v: F.struct(p.alias("part"), v.alias("value")))
    every = F.aggregate(pairs, start, step, lambda a: a["out"])
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(F.size(found) > 0, F.filter(every, lambda s: valid(kind, s["value"]))).otherwise(none)


def normal(word: Column) -> Column:
    """A word as a term: its letters in lower case, without what surrounds them."""
    return F.lower(F.regexp_replace(word, r"^[^\p{L}]++|[^\p{L}]++$", ""))


def base_spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id, tkey, and an array of spans per kind."""
    out = docs.select("doc_id", F.xxhash64("text").alias("tkey"), F.coalesce("text", F.lit("")).alias("text"))
    out = out.select("*", *[spans_of(F.col("text"), k).alias(f"{k}_found") for k in KINDS])
    return out.select("doc_id", "tkey", "text", *[located(F.col("text"), k, F.col(f"{k}_found")).alias(k) for k in KINDS])


def context(text: Column, start: Column, end: Column) -> Column:
    """Terms among the words beside a mention."""
    before = F.substr(text, F.greatest(F.lit(1), start - (CONTEXT_CHARS - 1)), F.least(start, F.lit(CONTEXT_CHARS)))
    after = F.substr(text, end + 1, F.lit(CONTEXT_CHARS))
    left = F.filter(F.split(before, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    right = F.filter(F.split(after, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    left = F.slice(left, F.greatest(F.lit(1), F.size(left) - (CONTEXT_WORDS - 1)), F.lit(CONTEXT_WORDS))
    words = F.concat(left, F.slice(right, F.lit(1), F.lit(CONTEXT_WORDS)))
    return F.array_distinct(F.filter(F.transform(words, normal), lambda w: F.length(w) >= TERM_LETTERS))


def entities(kind: str, value: Column) -> Column:
    """What a mention reveals: the value, its class and its kind."""
    cut = {
        "email": F.concat(F.lit("email:@"), F.lower(F.regexp_replace(value, "^.*@", ""))),
        "ip": F.concat(F.lit("ip:"), F.substring_index(value, ".", 2), F.lit(".")),
        "card": F.concat(F.lit("card:"), F.substring(digits(value), 1, ISSUER), F.lit("-")),
        "phone": F.concat(F.lit("phone:+"), F.substring(digits(value), 1, DIALLING), F.lit("-")),
    }[kind]
    return F.array(F.concat(F.lit(f"{kind}:"), value), cut, F.lit(kind))


def candidate_terms(mentions: DataFrame) -> DataFrame:
    """(term, entity, together): terms of SUPPORT different contexts of one
    entity, with the mentions they stand by. Copies of a passage are one
    context."""
    beside = mentions.select("entities", F.xxhash64("terms").alias("context"), F.explode("terms").alias("term"))
    beside = beside.select("term", F.explode("entities").alias("entity"), "context")
    per_context = beside.groupBy("term", "entity", "context").agg(F.count("*").alias("n"))
    both = per_context.groupBy("term", "entity").agg(F.count("*").alias("contexts"), F.sum("n").alias("together"))
    return both.where(F.col("contexts") >= SUPPORT).select("term", "entity", "together")


def disclosing_terms(docs: DataFrame, base: DataFrame) -> DataFrame:
    """(doc_id, tkey, terms): an array of (term, certain) for every document
    that holds disclosing terms. Counts cover all documents: every term's
    occurrences are counted before any is dropped."""
    mentions = base.select(F.explode("mentions").alias("m")).select("m.entities", "m.terms")
    candidates = materialize(candidate_terms(mentions), "terms")
    empty = docs.sparkSession.createDataFrame([], "doc_id long, tkey long, terms array<struct<term:string,certain:boolean>>")
    if candidates.isEmpty():
        return empty
    words = docs.select("doc_id", "text", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word"))
    places = words.select("doc_id", "text", normal(F.col("word")).alias("term")).where(F.length("term") >= TERM_LETTERS)
    vocabulary = materialize(places.groupBy("term").agg(F.count("*").alias("anywhere")), "vocabulary")
    corpus = vocabulary.agg(F.sum("anywhere")).first()[0] or 1
    given = F.least(F.lit(1.0), F.col("together") / F.col("anywhere"))
    likely = candidates.join(vocabulary, "term").withColumn("given", given).where(F.col("given") >= LIKELY)
    by_entity = mentions.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("mentions"))
    bits = F.log2(F.col("given") / (F.col("mentions") * 2 * CONTEXT_WORDS / F.lit(corpus)))
    strong = likely.join(by_entity, "entity").where(bits >= BITS).groupBy("term").agg(F.max(F.col("given") >= CERTAIN).alias("certain"))
    strong = materialize(strong, "strong")
    if strong.isEmpty():
        return empty
    hits = places.join(strong, "term").select("doc_id", F.xxhash64("text").alias("tkey"), "term", "certain")
    return hits.groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("term", "certain")).alias("terms"))


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, tkey, term): where a document's disclosing terms stand, as an
    array of (start, end, value); value is `removed` or `generalised`."""
    texts = docs.withColumn("tkey", F.xxhash64("text")).alias("d").join(terms.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.tkey") == F.col("p.tkey")))
    texts = texts.select("d.doc_id", "d.tkey", F.split("d.text", r"[\x20\x09-\x0D]", -1).alias("words"), F.map_from_entries("p.terms").alias("terms")).dropDuplicates(["doc_id", "tkey"])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(a: Column, w: Column) -> Column:
        certain = F.try_element_at(F.col("terms"), normal(w))
        begin = a["at"] + F.length(w) - F.length(F.regexp_replace(w, r"^[^\p{L}]++", ""))
        end = begin + F.length(normal(w))
        span = F.struct(begin.alias("start"), end.alias("end"), F.when(certain, "removed").otherwise("generalised").alias("value"))
        return F.struct((a["at"] + F.length(w) + 1).alias("at"), F.when(certain.isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(span))).alias("out"))

    return texts.select("doc_id", "tkey", F.aggregate("words", start, step, lambda a: a["out"]).alias(TERM))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, tkey (a hash of the text) and an array of (start, end, value)
    for each of email, ip, card, phone and term, for every row of docs (doc_id,
    text; other columns are ignored). Starts count from 0, ends are exclusive,
    both in code points. Null and empty texts have none, an empty table gives an
    empty one, a text of any length is read whole. Rows of one doc_id and text
    get equal results; spans of different kinds may overlap, and each of them
    stands. A context is CONTEXT_WORDS words to each side, of those within
    CONTEXT_CHARS characters."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = base_spans(docs)
    mention = lambda k: F.transform(k, lambda s: F.struct(entities(k, s["value"]).alias("entities"), context(F.col("text"), s["start"], s["end"]).alias("terms")))
    base = materialize(found.select("doc_id", "tkey", *KINDS, F.concat(*[mention(k) for k in KINDS]).alias("mentions")), "personal")
    terms = disclosing_terms(docs, base)
    added = term_spans(docs, terms)
    same = F.col("b.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("b.tkey") == F.col("t.tkey"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return base.alias("b").join(added.alias("t"), same, "left").select("b.doc_id", "b.tkey", *[f"b.{k}" for k in KINDS], F.coalesce(f"t.{TERM}", none).alias(TERM))


def named(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, kind by kind, joined by commas."""

    def of(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.concat_ws(",", F.concat(*[of(k) for k in kinds]))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with `clean`: the text with every span replaced by its kind in
    brackets; removed terms leave nothing. Of overlapping spans, the earliest
    stands and the others lose what it covers."""
    found = find_personal_data(docs).dropDuplicates(["doc_id", "tkey"])
    docs = docs.select(F.struct("*").alias("doc_")).select("doc_", "doc_.doc_id", "doc_.text")
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & F.xxhash64("d.text").eqNullSafe(F.col("p.tkey"))

    def labelled(kind: str) -> Column:
        label = F.lit(f"[{kind.upper()}]")
        return F.transform(f"p.{kind}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["value"] == "removed", "").otherwise(label).alias("label") if kind == TERM else label.alias("label")))

    spans = F.array_sort(F.concat(*[labelled(k) for k in (*KINDS, TERM)]))
    text = F.coalesce("d.text", F.lit(""))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        out = F.when(fresh, F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), s["label"])).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

    clean = F.aggregate(spans, begin, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))
    joined = docs.alias("d").join(found.alias("p"), same)
    return joined.select("d.doc_.*", F.when(F.col("d.text").isNull(), F.lit(None)).otherwise(clean).alias("clean"))
