"""Personal data by patterns, and terms that reveal it by how the corpus uses them.

Patterns find the protected entities (addresses, card and phone numbers). A term near an entity
reveals it when knowing the term tells most of the entity's information: with document counts over the
whole corpus, disclosure = PMI(entity; term) / IC(entity)
= log(N n(e,t) / (n(e) n(t))) / log(N / n(e)). Terms need `least_contexts` different
surroundings of the entity, so that copies of one text prove nothing. An entity that itself has fewer is
rare: a term near it is scored by the same formula with the finest group of entities that narrows it down (e-mail domain, IP
network, phone prefix, card issuer; never the mere kind) in whose surroundings, one of each text, it has them.
Terms at or above `remove_at`
are removed, those between `generalise_at` and that are generalised to a category mark; both only in texts that hold an
entity they reveal, so texts without personal data are never touched.

Defined cases: null and empty texts have no spans; copies and repeated rows get the same spans; spans of
different kinds may overlap and are rewritten as one; texts of any length are read whole; an empty table gives an empty result. A column
of the input that is named like a result is dropped in favour of the result.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, col, fresh, map_texts, text_or_empty

KINDS = ("email", "ip", "card", "phone")
AT = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# both start at the first digit of a run; nowhere else could a leftmost match start
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: One expression for surroundings and corpus counts, so combining marks stay in their words on both sides.
TERM_PATTERN = r"[\p{L}\p{M}]{3,}"
TERM = regex.compile(TERM_PATTERN)
#: Words on either side of an entity that count as its surroundings.
WINDOW = 6
GENERALISE_AT, REMOVE_AT, LEAST_CONTEXTS = 0.8, 0.95, 3
MARKS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "term": "<TERM>", "drop": ""}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their @ so that long runs without one cost nothing."""
    out, last = [], 0
    for m in AT.finditer(text) if "@" in text else ():
        if m.start() < last:
            continue
        start = m.start()
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            last = m.end()
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if not DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m.group())) <= 15]
    return out


def entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else ''.join(DIGIT.findall(value))}"


def levels(name: str) -> list[str]:
    """An entity, then the groups that narrow it down, from fine to coarse. Its kind is none: that some number
    follows is not whose it is."""
    kind, value = name.split(":", 1)
    if kind == "email":
        groups = [value.rsplit("@", 1)[1]]
    elif kind == "ip":
        groups = [value.rsplit(".", k)[0] for k in (1, 2)]
    elif kind == "phone":
        groups = [value[:-4], value[:-7]]
    else:
        groups = [value[:6]]
    return [name, *(f"{kind}/{g}" for g in groups)]


def surroundings(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, list[str]]]:
    """(entity, words around it) per span; words inside any span don't count."""
    words = [m.span() for m in TERM.finditer(text)]
    starts, ends = [a for a, _ in words], [b for _, b in words]
    out = []
    for kind, a, b in spans:
        before, after = bisect.bisect_right(ends, a), bisect.bisect_left(starts, b)
        near = words[max(0, before - WINDOW) : before] + words[after : after + WINDOW]
        out.append((entity(kind, text[a:b]), [text[x:y].lower() for x, y in near if not any(c < y and x < d for _, c, d in spans)]))
    return out


def term_spans(text: str, terms: dict[str, str], taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Every whole-word occurrence of the revealing terms outside of `taken`."""
    if not terms:
        return []
    found = [(terms[w], m.start(), m.end()) for m in TERM.finditer(text) if (w := m.group().lower()) in terms]
    return [s for s in found if not any(x < s[2] and s[1] < y for _, x, y in taken)]


def rewrite(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Replace spans by the mark of their kind; overlapping spans become one, marked by the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], MARKS[kind]]
        at = max(at, b)
    return "".join([*out, text[at:]])


def near_pairs(texts: DataFrame, least_contexts: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stands near entities in column `t`, per level: (found, keys, pairs).

    found: one row per span with its `keys` (see `levels`) and words; keys: (level, key) with documents and
    surroundings; pairs: (level, key, term) with documents, those with `least_contexts` surroundings.
    """
    near = T.StructType([T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("words", T.ArrayType(T.StringType()))])

    def run(batch: pa.RecordBatch) -> dict:
        around = [surroundings(t, s) if (s := base_spans(t)) else None for t in batch.column(0).to_pylist()]
        return {"near": [None if x is None else [{"keys": levels(e), "words": w} for e, w in x] for x in around]}

    found = map_texts(texts, run, T.StructType([T.StructField("near", T.ArrayType(near))]), "t")
    found = scratch.store(found.filter("near is not null").select(F.monotonically_increasing_id().alias("doc"), "near"), "near")
    found = found.select("doc", F.explode("near").alias("near")).select("doc", "near.keys", "near.words", F.xxhash64("near.words").alias("context"))
    standing = found.select("doc", "context", "words", F.posexplode("keys").alias("level", "key"))
    keys = standing.groupBy("level", "key").agg(F.countDistinct("doc").alias("n_e"), F.countDistinct("context").alias("contexts"))
    words = standing.select("level", "key", "doc", "context", F.explode("words").alias("term"))
    # one page that lists many entities of a group has as many windows, but is one piece of evidence
    own = F.when(F.col("level") == 0, F.col("context")).alias("own")
    words = words.groupBy("level", "key", "term", "doc", own).agg(F.min("context").alias("context"))
    pairs = words.groupBy("level", "key", "term").agg(F.countDistinct("doc").alias("n_et"), F.countDistinct("context").alias("contexts"))
    return found, keys, pairs.filter(F.col("contexts") >= least_contexts).drop("contexts")


def of_rare(found: DataFrame, keys: DataFrame, pairs: DataFrame, least_contexts: int) -> DataFrame:
    """(entity, level, columns of `pairs`) for every term near an entity at each level that may score it: the
    entity's own, and if the entity is rare those of its groups."""
    each = found.select(F.col("keys")[0].alias("entity"), "keys", F.explode("words").alias("term")).distinct()
    each = each.select("entity", "term", F.posexplode("keys").alias("level", "key"))
    frequent = keys.filter((F.col("level") == 0) & (F.col("contexts") >= least_contexts)).select(F.col("key").alias("entity"), F.lit(True).alias("frequent"))
    return each.join(pairs, ["level", "key", "term"]).join(frequent, "entity", "left").filter("level = 0 or frequent is null").drop("frequent")


def scored_levels(docs: DataFrame, text: str = "text", least_contexts: int = LEAST_CONTEXTS) -> DataFrame:
    """(kind, level, entities): how many different entities have their terms scored, by the finest level
    (`levels` counted from 0) that scores one; null where none does."""
    found, keys, pairs = near_pairs(docs.select(text_or_empty(text).alias("t")), least_contexts, Scratch(docs.sparkSession))
    finest = of_rare(found, keys, pairs, least_contexts).groupBy("entity").agg(F.min("level").alias("level"))
    every = keys.filter("level = 0").select(F.col("key").alias("entity"))
    return every.join(finest, "entity", "left").groupBy(F.substring_index("entity", ":", 1).alias("kind"), "level").agg(F.count("*").alias("entities"))


def revealing_terms(docs: DataFrame, text: str = "text", generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT,
                    least_contexts: int = LEAST_CONTEXTS, scratch: Scratch | None = None) -> DataFrame:
    """(entity, term, level, disclosure, action): terms whose use across all of `docs` gives an entity away."""
    scratch = scratch or Scratch(docs.sparkSession)
    texts = docs.select(text_or_empty(text).alias("t"))
    found, keys, pairs = near_pairs(texts, least_contexts, scratch)
    near = found.select("doc", F.explode("words").alias("term")).groupBy("term").agg(F.countDistinct("doc").alias("n_near"))
    total = texts.agg(F.count("*").alias("n"))

    def told(n_t: str) -> Column:
        share = F.log(F.col("n") * F.col("n_et") / (F.col("n_e") * F.col(n_t))) / F.log(F.col("n") / F.col("n_e"))
        return F.when(F.col("n") > F.col("n_e"), share).otherwise(F.lit(0.0))

    # a term occurs in at least as many documents as it stands near entities, so its disclosure there is
    # an upper bound; terms that reveal at no level fall out before the corpus is counted, others keep all
    # their levels, since a level with counts that reveals nothing stops the coarser ones
    known = keys.filter(F.col("contexts") >= least_contexts).drop("contexts")
    pairs = pairs.join(known, ["level", "key"]).join(near, "term").withColumn("n", total.scalar())
    pairs = scratch.store(pairs.withColumn("most", told("n_near")), "pairs")
    pairs = pairs.join(pairs.filter(F.col("most") >= generalise_at - 1e-9).select("term").distinct(), "term", "left_semi")
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(TERM_PATTERN), F.lit(0)))).alias("term"))
    # counted before the join: tasks send one row per word they have seen, however many terms are asked for
    counts = words.groupBy("term").agg(F.count("*").alias("n_t"))
    scored = scratch.store(pairs.join(counts, "term").select("level", "key", "term", told("n_t").alias("disclosure")), "scored")
    scored = scored.join(scored.filter(F.col("disclosure") >= generalise_at).select("term").distinct(), "term", "left_semi")
    finest = of_rare(found, keys, scored, least_contexts).groupBy("entity", "term").agg(F.min(F.struct("level", "disclosure")).alias("at"))
    action = F.when(F.col("disclosure") >= remove_at, "drop").otherwise("term")
    return finest.select("entity", "term", "at.*").filter(F.col("disclosure") >= generalise_at).withColumn("action", action)


def find_personal_data(docs: DataFrame, text: str = "text", spans: str = "spans", clean: str | None = None, **limits) -> DataFrame:
    """Append `spans` (kind, start, end: patterns by kind, then terms) and, if named, the sanitised text.

    Texts are joined with nothing but the terms found in their own copies, keyed by the text's hash; that
    table is stored first, so Spark knows its size before it chooses between a broadcast and a shuffle.
    """
    scratch = Scratch(docs.sparkSession)
    revealing = scratch.store(revealing_terms(docs, text, scratch=scratch, **limits), "revealing")
    texts = docs.select(text_or_empty(text).alias("t"))

    def holders(batch: pa.RecordBatch) -> dict:
        return {"entities": [sorted({entity(k, t[a:b]) for k, a, b in s}) if (s := base_spans(t)) else None for t in batch.column(0).to_pylist()]}

    held = map_texts(texts, holders, T.StructType([T.StructField("entities", T.ArrayType(T.StringType()))]), "t")
    held = held.filter("entities is not null").select(F.xxhash64("t").alias("x"), F.xxhash64("t", F.lit(1)).alias("y"), F.explode("entities").alias("entity")).distinct()
    per_text = held.join(revealing, "entity").groupBy("x", "y").agg(F.array_sort(F.collect_set(F.concat_ws(":", "action", "term"))).alias("terms"))
    per_text = scratch.store(per_text, "terms")

    source, terms = fresh(docs, "text_in"), fresh(docs, "terms_")
    keep = [c for c in docs.columns if c.lower() not in (spans.lower(), (clean or spans).lower())]
    docs = docs.select(*[col(c) for c in keep], text_or_empty(text).alias(source))
    joined = docs.join(per_text.select(F.col("x").alias("x_"), F.col("y").alias("y_"), F.col("terms").alias(terms)), (F.xxhash64(source) == F.col("x_")) & (F.xxhash64(source, F.lit(1)) == F.col("y_")), "left")
    joined = joined.select(*[col(c) for c in keep], source, terms)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    add = [T.StructField(spans, T.ArrayType(span))] + ([T.StructField(clean, T.StringType())] if clean else [])

    def run(batch: pa.RecordBatch) -> dict:
        names = batch.schema.names
        all_spans, texts_out = [], []
        for t, listed in zip(batch.column(names.index(source)).to_pylist(), batch.column(names.index(terms)).to_pylist()):
            found = base_spans(t)
            if found and listed:
                found += term_spans(t, {w: a for a, w in (x.split(":", 1) for x in reversed(listed))}, found)
            all_spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            texts_out.append(rewrite(t, found) if found else t)
        return {spans: all_spans} | ({clean: texts_out} if clean else {})

    return map_texts(joined, run, T.StructType(add), source).drop(source, terms)
