"""Personal data: base patterns, and information-theoretic sanitisation of what stands near them, in DataFrame
operations only.

Base spans are e-mail and IP addresses, card and phone numbers. A term that stands by itself in the sentence of an entity
(a base span's value) co-occurs with it. Of N(t) occurrences of a term in the corpus n(e, t) are with the entity, in
d(e, t) different sentences; so the chance that the term points at the entity is estimated as n / N * d / (d + 1), which
shrinks what little evidence says. It reveals log2(chance) + IC(e) of the IC(e) = -log2(n(e) / T) bits that identify the
entity among T terms (the smoothed pointwise mutual information). Terms that reveal at least ``SHARE`` of these bits
become spans of kind "term", wherever they stand in a text that has them in the entity's sentence. Every pair of an
entity and a term in its sentence is judged; entities seen once, too, have their rare neighbours.

Null and empty texts have no spans; texts without base spans have none. Equal rows are judged alike; rows that repeat
an id with another text are judged by their own text. Sentences are looked at up to ``REACH`` characters to each side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import materialize, release

KINDS = ("email", "ip", "card", "phone")
#: Leftmost matches start where a run of their first characters does, or where the last match ended; possessive
#: runs keep the time linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Texts that fail these have no valid match.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"(?:[0-9][ -]?){15}[0-9]", "phone": r"\+[0-9]"}
REACH, SHARE = 256, 0.9
TERM = r"(?<![\p{L}\p{N}@._%+-])\p{L}{3,}+(?![\p{N}@_%+-]|\.[\p{L}\p{N}])"
_BLOCK = 256


def _located(text: str, pattern: str) -> str:
    """SQL for the matches of a pattern as (s, e, v): start and end in code points, and the text.

    Pieces between matches and matches alternate; starts are sums of their lengths, taken in blocks so that
    texts with very many matches stay cheap."""
    total = lambda a, n: f"aggregate(slice({a}, 1, {n}), 0, (t, x) -> t + length(x))"
    block = f"""aggregate(sequence(b * {_BLOCK}, least(size(z.m), b * {_BLOCK} + {_BLOCK}) - 1),
        named_struct('at', {total("z.p", f"b * {_BLOCK}")} + {total("z.m", f"b * {_BLOCK}")}, 'out', cast(array() as array<struct<s: int, e: int, v: string>>)),
        (acc, i) -> named_struct('at', acc.at + length(z.p[i]) + length(z.m[i]),
          'out', array_append(acc.out, named_struct('s', acc.at + length(z.p[i]), 'e', acc.at + length(z.p[i]) + length(z.m[i]), 'v', z.m[i]))),
        acc -> acc.out)"""
    none = "cast(array() as array<struct<s: int, e: int, v: string>>)"
    whole = f"case when size(z.m) = 0 then {none} else flatten(transform(sequence(0, cast(floor((size(z.m) - 1) / {_BLOCK}) as int)), b -> {block})) end"
    # the one-element array binds pieces and matches, so that they are computed once
    return f"element_at(transform(array(named_struct('p', split({text}, {pattern}, -1), 'm', regexp_extract_all({text}, {pattern}, 0))), z -> {whole}), 1)"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


_VALID = {
    "email": "true",
    "ip": "forall(split(x.v, '[.]'), q -> length(ltrim('0', q)) < 3 or (length(ltrim('0', q)) = 3 and ltrim('0', q) <= '255'))",
    "card": "length(translate(x.v, ' -', '')) between 16 and 19 and luhn_check(translate(x.v, ' -', ''))",
    "phone": "length(regexp_replace(x.v, '[^0-9]', '')) between 8 and 15",
}


def base_spans(kind: str) -> Column:
    """The valid spans of a kind in column ``text``."""
    none = "cast(array() as array<struct<s: int, e: int, v: string>>)"
    found = f"filter({_located('text', _quoted(PATTERNS[kind]))}, x -> {_VALID[kind]})"
    return F.expr(f"case when text rlike {_quoted(HINTS[kind])} then {found} else {none} end")


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


#: Where sentences end: a full stop, question or exclamation mark before a blank, and a line's end.
_SENTENCE_END = r"[.!?](?=\\s)|\\n"


def _contexts() -> Column:
    """Of every base span its value and the text around it, up to REACH characters to each side."""
    parts = []
    for kind in KINDS:
        parts.append(f"""transform({kind}, x -> named_struct('entity', concat('{kind}:', lower(x.v)), 'cut', x.s > {REACH},
          'before', substring(text, greatest(x.s - {REACH}, 0) + 1, least(x.s, {REACH})), 'after', substring(text, x.e + 1, {REACH})))""")
    return F.expr(f"concat({', '.join(parts)})")


def found_in(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text hash, base spans by kind, and, if there are any, contexts and the text; a table in the
    shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *(base_spans(k).alias(k) for k in KINDS))
    some = F.expr(" + ".join(f"size({k})" for k in KINDS)) > 0
    return materialize(rows.select("doc_id", F.xxhash64("text").alias("h"), *KINDS, _contexts().alias("contexts"), F.when(some, F.col("text")).alias("held")), "spans")


def pairs_of(found: DataFrame) -> DataFrame:
    """doc_id, h, entity, the hash of its sentence (around) and a term in it, for each base span and term."""
    flat = found.select("doc_id", "h", F.explode("contexts").alias("c")).select("doc_id", "h", "c.*")
    # a word that the window cuts is no term
    before = f"element_at(split(before, '{_SENTENCE_END}'), -1)"
    before = f"case when cut and size(split(before, '{_SENTENCE_END}')) = 1 then regexp_replace({before}, '^\\\\S*', '') else {before} end"
    after = f"element_at(split(after, '{_SENTENCE_END}'), 1)"
    after = f"case when length(after) = {REACH} and size(split(after, '{_SENTENCE_END}')) = 1 then regexp_replace({after}, '\\\\S*$', '') else {after} end"
    flat = flat.select("doc_id", "h", "entity", F.lower(F.concat(F.expr(before), F.lit(" \n "), F.expr(after))).alias("around"))
    terms = F.expr(f"array_distinct(regexp_extract_all(around, {_quoted(TERM)}, 0))")
    return materialize(flat.select("doc_id", "h", "entity", F.xxhash64("around").alias("around"), F.explode(terms).alias("term")), "pairs")


def disclosing(docs: DataFrame, found: DataFrame, pairs: DataFrame, share: float = SHARE) -> DataFrame:
    """(entity, term) of the terms that disclose an entity."""
    entities = found.select(F.explode("contexts.entity").alias("e2")).groupBy("e2").agg(F.count("*").alias("ne"))
    # copies of a sentence meet here first, before different sentences are counted
    counted = pairs.groupBy("entity", "term", "around").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.count("*").alias("different"), F.sum("n").alias("net"))
    words = docs.select(F.explode(F.expr(f"regexp_extract_all(lower(text), {_quoted(TERM)}, 0)")).alias("word")).groupBy("word").agg(F.count("*").alias("nt"))
    words = materialize(words, "words")
    total = words.agg(F.sum("nt")).first()[0] or 0
    joined = counted.join(words, F.col("term") == F.col("word")).join(entities, F.col("entity") == F.col("e2"))
    bits = -F.log2(F.least(F.col("ne") / F.lit(float(max(total, 1))), F.lit(1.0)))
    chance = F.least(F.col("net") / F.col("nt"), F.lit(1.0)) * F.col("different") / (F.col("different") + 1)
    out = materialize(joined.where((bits > 0) & (F.log2(chance) + bits >= share * bits)).select(F.col("entity").alias("de"), F.col("term").alias("dt")), "disclosing")
    release(words)
    return out


def spans_by_row(docs: DataFrame) -> DataFrame:
    """doc_id, text hash (h) and the spans of each kind, "term" included, of every row."""
    found = found_in(docs)
    pairs = pairs_of(found)
    text = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    terms = pairs.join(disclosing(text, found, pairs), (F.col("entity") == F.col("de")) & (F.col("term") == F.col("dt")))
    # as many as a text has words at most
    terms = materialize(terms.groupBy(F.col("doc_id").alias("xid"), F.col("h").alias("xh")).agg(F.collect_set("term").alias("terms")), "terms")
    release(pairs)
    out = found.join(terms, F.col("doc_id").eqNullSafe(F.col("xid")) & (F.col("h") == F.col("xh")), "left")
    located = f"transform(filter({_located('held', _quoted(TERM))}, x -> array_contains(terms, lower(x.v))), x -> named_struct('s', x.s, 'e', x.e))"
    term = F.expr(f"case when terms is null then cast(array() as array<struct<s: int, e: int>>) else {located} end")
    return out.select("doc_id", "h", *KINDS, term.alias("term"))


def spans_report(docs: DataFrame) -> DataFrame:
    """Counts of base spans, their digest, and all spans, of every row."""
    base = F.concat(*(_listed(k, F.col(k)) for k in KINDS))
    return spans_by_row(docs).select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.concat(base, _listed("term", F.col("term"))), ",").alias("spans"),
    )


#: What a span of each kind is generalised to.
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}


def sanitize(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which base spans are generalised to their kinds and disclosing terms to "[TERM]"."""
    spans = spans_by_row(docs)
    labelled = F.expr("concat({})".format(", ".join(f"transform({k}, x -> named_struct('s', x.s, 'e', x.e, 'label', '{v}'))" for k, v in LABELS.items())))
    spans = spans.select(F.col("doc_id").alias("sid"), F.col("h").alias("sh"), F.sort_array(labelled).alias("cuts")).dropDuplicates(["sid", "sh"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("sid")) & (F.xxhash64("text") == F.col("sh")))
    # spans that overlap an earlier one give way
    return joined.select("doc_id", F.expr("""aggregate(cuts, named_struct('at', 0, 'out', cast(array() as array<string>)),
        (acc, x) -> if(x.s < acc.at, acc, named_struct('at', x.e, 'out', concat(acc.out, array(substring(text, acc.at + 1, x.s - acc.at), x.label)))),
        acc -> concat(array_join(acc.out, ''), substring(text, acc.at + 1)))""").alias("text"))  # fmt: skip
