"""Personal data: fixed patterns, and identifiers found by the words around them.

Base spans are the leftmost non-overlapping matches of one pattern for each
kind, less those that fail the kind's rule. They are the seeds of a bootstrap.
Base spans, identifier-shaped tokens and matches with spaces that fail their rule
form, with what stands around them, a bipartite graph of instances and lexical
patterns. Patterns are of five sorts, from narrow to wide: the word on either
side ("l1 _ r1"), two words before ("l2 l1 _"), one word before ("l1 _"), a name
glued to its value ("name=_"), and the first letters of a long token ("ABCD...").
Marks beside the slot belong to the pattern; letters are compared in lower case.

Tokens of a key's shape (KEY_SHAPE) are weak seeds of a fifth kind, secret: their
own worth is PRIOR, a toss of a coin, and only the graph can raise it. A pattern's
confidence is the mean worth of its distinct instances; an instance's worth is 1
for base spans and else one minus the product of its own doubt and those of its
patterns. Both are computed again in ROUNDS rounds, so that a pattern that only
keys stand in rises to certainty and one that holds anything else stays behind.
Patterns of high confidence and enough distinct seeds are then held against the
whole corpus: every other word that stands in the slot is a doubt. Those that
stay trusted mark what stands in them, whatever its shape and length, as unseen
identifiers. An unseen identifier of several words is found only in the shape of
a phone, card or ip. Base spans always stay, and no found span meets one.

Everything here is DataFrame expressions: no Python runs on the executors.

Rows: one output row per input row. A null text is an empty text and has no
spans. Repeated rows get equal results; extra columns, whatever their names, are
ignored by find_pii and kept by mask_documents; an empty table gives an empty
result. Of overlapping found spans those of identifier shape go first, then the
leftmost, then the longest. Texts are read whole; the patterns are possessive
and anchored to the start of runs, so that their time is linear in the text.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, require, whole_row, whole_text, written

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, made possessive: they match the same strings.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Identifier-shaped tokens: phone numbers, and runs of at least 6 characters with a digit.
CANDIDATE = PATTERNS["phone"] + r"|(?<![A-Za-z0-9@._%+-])(?=[A-Za-z@._%+-]*+[0-9])[A-Za-z0-9@._%+-]{6,}+(?![A-Za-z0-9@._%+-])"
SPANS = "array<struct<start: bigint, kind: int, stop: bigint>>"
#: Kinds of all spans; those beyond KINDS are found by context alone.
FOUND_KINDS = (*KINDS, "secret")
SECRET = FOUND_KINDS.index("secret")
#: Keys look like this: long, with letters and digits, and no word of a language in it.
KEY_SHAPE = r"^(?=(?:[^0-9]*+[0-9]){2})(?=(?:[^A-Za-z]*+[A-Za-z]){3})(?!.*[a-z]{12})[A-Za-z0-9_+/=-]{16,}$"
#: Worth of a token of that shape before anything is known of where it stands.
PRIOR = 0.5
MATCHES = "array<struct<start: bigint, stop: bigint, value: string, before: string, after: string, kind: int>>"
ROUNDS = 5
MIN_SEEDS = 5
MIN_CONFIDENCE = 0.8
MIN_SCORE = 0.9
#: Documents that patterns are tried on before they are looked up in all; any number gives the same result.
FIRST_DOCS = 2_000
#: Patterns up to which texts are searched for each of them before their words are; any number gives the same result.
NEEDLES = 32
#: Words before slots up to which other words are passed over; any number gives the same result.
LEADS = 20_000
#: Characters beside a token that are searched for its context words.
CONTEXT_CHARS = 80


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    backward = F.split(F.reverse(digits), "")

    def worth(x: Column, i: Column) -> Column:
        d = F.coalesce(x.try_cast("int"), F.lit(0))
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(backward, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern passes the kind's rule."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: F.coalesce(F.regexp_replace(x, "^0+(?=.)", "").try_cast("int"), F.lit(256)) <= 255)
    digits = _digits(value)
    n = F.length(digits)
    if kind == "phone":
        return n.between(10, 15)
    return F.when(n.between(14, 19), _luhn(digits)).otherwise(F.lit(False))


def _placed(df: DataFrame, text: str, pattern: str, out: str, context: bool = False) -> DataFrame:
    """Add out: array of (start, stop, value[, before, after]) of all matches, in code points.

    The text is split at the matches; starts are sums of lengths, taken in
    blocks of the square root of their number, so that many matches cost n**1.5.
    """
    m, g, a, b, s = (f"{out}_{x}" for x in "mgabs")
    df = df.withColumn(m, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    df = df.withColumn(g, F.when(F.size(m) > 0, F.split(text, pattern, -1)))
    df = df.withColumn(a, F.zip_with(F.transform(g, F.length), F.transform(m, F.length), lambda x, y: F.coalesce(x, F.lit(0)).cast("long") + F.coalesce(y, F.lit(0))))
    step = F.greatest(F.lit(1), F.sqrt(F.size(m)).cast("int"))
    df = df.withColumn(s, step)
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda p, q: p + q)
    df = df.withColumn(b, F.transform(F.sequence(F.lit(0), F.expr(f"size({m}) div {s}")), lambda j: total(F.slice(a, F.lit(1), j * F.col(s)))))

    def span(value: Column, i: Column) -> Column:
        block = F.floor(i / F.col(s)).cast("int")
        start = F.get(F.col(b), block) + total(F.slice(a, block * F.col(s) + 1, i - block * F.col(s))) + F.length(F.get(F.col(g), i))
        fields = [start.alias("start"), (start + F.length(value)).alias("stop"), value.alias("value")]
        if context:
            fields += [F.right(F.get(F.col(g), i), F.lit(CONTEXT_CHARS)).alias("before"), F.left(F.get(F.col(g), i + 1), F.lit(CONTEXT_CHARS)).alias("after")]
        return F.struct(*fields)

    df = df.withColumn(out, F.when(F.size(m) > 0, F.transform(m, span)))
    return df.drop(m, g, a, b, s)


def _told(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in FOUND_KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["stop"])), ",")


def _seen(kind: str, n: int) -> Column:
    """A kind's matches with their context: the valid ones have the kind, the others (null) stay if they are several whole words."""
    found = F.transform(kind, lambda x: x.withField("kind", F.when(valid(kind, x["value"]), F.lit(n))))
    apart = lambda x: x["value"].contains(" ") & ~x["before"].rlike(r"[^\s(]$") & ~x["after"].rlike(r"^[^\s).,;:!?]")
    return F.filter(found, lambda x: x["kind"].isNotNull() | apart(x))


def _spans(seen: Column) -> Column:
    return F.transform(F.filter(seen, lambda x: x["kind"].isNotNull()), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop")))


def _count(spans: str, n: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == n)).cast("long")


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, base, matches, candidates): base is sorted (start, kind, stop); matches, with a kind if valid, and candidates have their context."""
    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("mark", F.xxhash64("text"))
    seen, spans = [], []
    for n, kind in enumerate(KINDS):
        rows = _placed(rows, "text", PATTERNS[kind], kind, context=True)
        rows = rows.withColumn(kind, _seen(kind, n))
        seen.append(F.coalesce(kind, F.array().cast(MATCHES)))
        spans.append(F.coalesce(_spans(F.col(kind)), F.array().cast(SPANS)))
    rows = _placed(rows, "text", CANDIDATE, "candidates", context=True)
    return rows.select("doc_id", "mark", F.array_sort(F.concat(*spans)).alias("base"), F.concat(*seen).alias("matches"), "candidates")


def occurrences(found: DataFrame) -> DataFrame:
    """(doc_id, mark, start, stop, value, kind, patterns) of every match and candidate; kind: that of a base span, else null."""
    value = F.col("c.value")
    whole = [(F.regexp_extract(value, PATTERNS[k], 0), k) for k in KINDS]
    # Candidates that are base spans by themselves are among the matches.
    own = F.coalesce(*[F.when((v != "") & valid(k, v), F.lit(True)) for v, k in whole], F.lit(False))
    x = found.where("candidates IS NOT NULL").select("doc_id", "mark", F.explode("candidates").alias("c")).where(~own).withColumn("kind", F.lit(None).cast("int"))
    x = x.unionByName(found.select("doc_id", "mark", F.explode("matches").alias("c")).select("doc_id", "mark", F.col("c").dropFields("kind").alias("c"), F.col("c.kind").alias("kind")))
    # What is glued to the value on either side, and the words beyond.
    before, after = F.lower("c.before"), F.lower("c.after")
    glue, tail = F.regexp_extract(before, r"(\S*)$", 1), F.regexp_extract(after, r"^(\S*)", 1)
    words = lambda c: F.regexp_extract_all(c, F.lit(f"({WORD})"), F.lit(1))
    x = x.withColumn("l", words(F.left(before, F.length(before) - F.length(glue)))).withColumn("r", words(F.substr(after, F.length(tail) + 1)))
    x = x.withColumn("glue", glue).withColumn("tail", tail)
    l1, l2, r1 = (F.coalesce(F.try_element_at(F.col(side), F.lit(n)), F.lit("")) for side, n in (("l", -1), ("l", -2), ("r", 1)))
    sorts = _sorts(F.lower(value), F.col("glue"), F.col("tail"), l1, l2, r1)
    named = F.when(F.col("glue").rlike(GLUED), F.concat(F.lit("glued:"), "glue", F.lit("_")))
    plain = ~F.col("glue").rlike(ALNUM)
    found = [named if k == "glued" else p if k == "affix" else F.when(plain & (~F.col("tail").rlike(ALNUM) if k == "around" else F.lit(True)), p) for k, p in sorts.items()]
    worth = F.when(F.col("kind").isNotNull(), 1.0).when(value.rlike(KEY_SHAPE), PRIOR).otherwise(0.0)
    x = x.select("doc_id", "mark", "c.start", "c.stop", value.alias("value"), "kind", worth.alias("worth"), F.array_compact(F.array(*found)).alias("patterns"))
    return x.where("size(patterns) > 0")


ALNUM = r"[\p{L}\p{N}]"
#: A name with the sign, and perhaps the quote, that its value follows.
GLUED = r"^[^=:]*\p{L}[^=:]*[=:]['\"]?$"
AFFIX_LETTERS, AFFIX_LENGTH = 4, 16


def _sorts(value: Column, lead: Column, tail: Column, l1: Column, l2: Column, r1: Column) -> dict[str, Column]:
    """The patterns of a slot by their sort, each named with its sort; null where a sort has none."""
    has = lambda w: w.rlike(r"\p{L}")
    slot = F.concat(lead, F.lit("_"))
    return {
        "around": F.when(has(l1) & has(r1), F.concat(F.lit("around:"), l1, F.lit(" "), slot, tail, F.lit(" "), r1)),
        "two": F.when((l2 != "") & (l1 != "") & (has(l1) | has(l2)), F.concat(F.lit("two:"), l2, F.lit(" "), l1, F.lit(" "), slot)),
        "one": F.when(has(l1), F.concat(F.lit("one:"), l1, F.lit(" "), slot)),
        "glued": F.lit(None).cast("string"),
        "affix": F.when((F.length(value) >= AFFIX_LENGTH) & value.rlike(rf"^\p{{L}}{{{AFFIX_LETTERS}}}"), F.concat(F.lit("affix:"), F.left(value, F.lit(AFFIX_LETTERS)))),
    }


def graph(seen: DataFrame) -> DataFrame:
    """(pattern, value, kind, worth): the distinct instances of every pattern; kind: of a base span, or secret, or null."""
    kind = F.coalesce("kind", F.when(F.col("worth") > 0, F.lit(SECRET)))
    rows = seen.select("value", kind.alias("kind"), "worth", F.explode("patterns").alias("pattern"))
    return written(rows.groupBy("pattern", "value").agg(F.max_by("kind", "worth").alias("kind"), F.max("worth").alias("worth")), "graph")


def good_patterns(edges: DataFrame) -> DataFrame:
    """(pattern, kind, confidence, instances) of the patterns that earn trust over the whole corpus."""
    scores = None
    for _ in range(ROUNDS):
        scored = edges if scores is None else edges.join(scores, "value", "left")
        worth = F.col("worth") if scores is None else 1 - (1 - F.col("worth")) * (1 - F.coalesce("score", F.lit(0.0)))
        patterns = scored.groupBy("pattern").agg(F.avg(worth).alias("confidence"), F.count("kind").alias("seeds"), F.count("*").alias("instances"), F.mode("kind", True).alias("kind"))
        patterns = written(patterns.where(F.col("seeds") >= MIN_SEEDS), "patterns")
        trust = F.least(F.col("confidence"), F.lit(0.999))
        scores = edges.where("worth < 1").join(patterns.select("pattern", trust.alias("trust")), "pattern")
        scores = scores.groupBy("value").agg((1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("score"))
        scores = written(scores, "scores")
    return patterns.where(F.col("confidence") >= MIN_CONFIDENCE).select("pattern", "kind", "confidence", "instances")


def _bare(word: Column) -> Column:
    """A word without the marks around it."""
    return F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


#: What comes before the slot in a word that holds it: marks, or a name with its sign.
_LEAD = r"^([^\p{L}\p{N}]*)"
_NAME = r"^([^=:]*\p{L}[^=:]*[=:]['\"]?)(?=[\p{L}\p{N}])"


def _slots(low: str, sorts: set[str], leads: list[str] | None = None) -> Column:
    """Array of (pattern, word, at) of a column of lower-case words: the patterns of the given sorts that each word stands in.

    With leads, words that come after none of these are passed over, unless a sort without a word before the slot may take them.
    """
    n = F.size(low)
    blank = F.array(F.lit(""))
    # No lambda may name the array itself: it would be made again for every element.
    before = lambda k: F.concat(*[blank] * k, F.slice(low, F.lit(1), F.greatest(n - k, F.lit(0))))
    zipped = F.arrays_zip(F.col(low).alias("w"), before(1).alias("l1"), before(2).alias("l2"), F.concat(F.slice(low, F.lit(2), n), blank).alias("r1"), F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")).alias("at"))
    if leads is not None:
        zipped = F.filter(zipped, lambda x: _may_stand(x, sorts, leads))

    def of(x: Column) -> Column:
        w, i = x["w"], x["at"]
        lead = F.regexp_extract(w, _LEAD, 1)
        tail = F.regexp_extract(w, r"([^\p{L}\p{N}]*)$", 1)
        rest = F.substr(w, F.length(lead) + 1)
        made = _sorts(_bare(w), lead, tail, x["l1"], x["l2"], x["r1"])
        name = F.regexp_extract(w, _NAME, 1)
        out = []
        for k in sorted(sorts):
            if k == "glued":
                slot = F.when(w.rlike("[=:]") & (name != ""), F.struct(F.concat(F.lit("glued:"), name, F.lit("_")).alias("pattern"), F.substr(w, F.length(name) + 1).alias("word"), i.alias("at")))
            else:
                slot = F.when(made[k].isNotNull() & (rest != ""), F.struct(made[k].alias("pattern"), rest.alias("word"), i.alias("at")))
            out.append(slot)
        return F.array_compact(F.array(*out))

    return F.flatten(F.transform(zipped, of)).cast("array<struct<pattern:string,word:string,at:int>>")


def _may_stand(x: Column, sorts: set[str], leads: list[str]) -> Column:
    """False for words in whose place no pattern of these sorts, with these words before the slot, can be; a look at each word that costs little."""
    can = x["l1"].isin(leads) if leads else F.lit(False)
    if "glued" in sorts:
        can |= x["w"].contains("=") | x["w"].contains(":")
    return can | (F.length(x["w"]) >= AFFIX_LENGTH) if "affix" in sorts else can


def _leads_of(patterns: DataFrame) -> list[str] | None:
    """The words right before the slots of the patterns, for the sorts that have one; None if there are too many to look for."""
    words = F.split(F.regexp_replace("pattern", "^[a-z]+:", ""), " ")
    lead = F.get(words, F.when(F.col("pattern").startswith("two:"), 1).otherwise(0))
    some = patterns.where(~F.substring_index("pattern", ":", 1).isin("glued", "affix")).select(lead).distinct().limit(LEADS + 1).collect()
    return [r[0] for r in some] if len(some) <= LEADS else None


def _sorts_of(patterns: DataFrame) -> set[str]:
    """The sorts that occur: a handful at most."""
    return {r[0] for r in patterns.select(F.substring_index("pattern", ":", 1)).distinct().collect()}


def _needle(pattern: str) -> str:
    """A string that every lower-case text with the pattern holds."""
    sort, _, body = pattern.partition(":")
    words = body.split(" ")
    if sort == "affix":
        return body
    return body[:-1] if sort == "glued" else max(words[:2] if sort == "two" else [words[0], words[-1]] if sort == "around" else words[:1], key=len)


def _may_hold(low: Column, patterns: DataFrame) -> Column:
    """False for texts that hold none of the patterns for certain; with more patterns than are worth looking for one by one, true."""
    some = [r[0] for r in patterns.select("pattern").limit(NEEDLES + 1).collect()]
    if len(some) > NEEDLES:
        return F.lit(True)
    return functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(n)) for n in sorted({_needle(p) for p in some})], F.lit(False))


def slot_words(docs: DataFrame, edges: DataFrame, trusted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sure, fills): patterns that are trusted with every other word of their slots as a doubt, and (doc_id, mark, pattern, at) of the words in the slots of trusted ones."""
    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("mark", F.xxhash64("text"))
    known = edges.select("pattern", _bare(F.lower(F.get(F.split("value", " "), F.lit(0)))).alias("word")).distinct()

    def filled(texts: DataFrame, patterns: DataFrame) -> DataFrame:
        low = texts.withColumn("lower", F.lower("text")).where(_may_hold(F.col("lower"), patterns))
        low = low.select("doc_id", "mark", F.regexp_extract_all("lower", F.lit(f"({WORD})"), F.lit(1)).alias("low"))
        return low.select("doc_id", "mark", F.inline(_slots("low", _sorts_of(patterns), _leads_of(patterns)))).join(patterns.select("pattern"), "pattern")

    def doubted(fills: DataFrame, patterns: DataFrame) -> DataFrame:
        fills = fills.select("pattern", _bare(F.col("word")).alias("word")).distinct()
        doubts = fills.join(known, ["pattern", "word"], "left_anti").groupBy("pattern").agg(F.count("*").alias("doubts"))
        trust = F.col("confidence") * F.col("instances") / (F.col("instances") + F.coalesce("doubts", F.lit(0)))
        return patterns.join(doubts, "pattern", "left").withColumn("trust", trust).where(F.col("trust") >= MIN_CONFIDENCE)

    # More texts can only add doubts: a pattern that some texts refute is not looked up in all.
    some = docs.where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIRST_DOCS)
    left = written(doubted(filled(rows.join(F.broadcast(some), "doc_id"), trusted), trusted).select(*trusted.columns), "left")
    if left.isEmpty():
        none = rows.select("doc_id", "mark", F.lit("").alias("pattern"), F.lit(0).alias("at")).limit(0)
        return left.select("pattern", "kind", F.lit(0.0).alias("trust")), none
    fills = written(filled(rows, left), "fills")
    sure = written(doubted(fills, left).select("pattern", "kind", "trust"), "sure")
    return sure, fills.select("doc_id", "mark", "pattern", "at")


def loose_occurrences(docs: DataFrame, sure: DataFrame, fills: DataFrame) -> DataFrame:
    """(doc_id, mark, start, stop, kind, trust) of the words in slots of the patterns that are sure."""
    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("mark", F.xxhash64("text"))
    fills = fills.join(sure, "pattern").withColumn("glued", F.col("pattern").startswith("glued:"))
    # Only texts that hold such a pattern have their words placed; those that cannot are not even dealt out.
    rows = rows.where(_may_hold(F.lower("text"), sure))
    held = fills.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    rows = rows.join(held, rows["doc_id"].eqNullSafe(held["_id"]) & (rows["mark"] == held["_mark"]), "left_semi")
    rows = written(_placed(rows.dropDuplicates(["doc_id", "mark"]), "text", WORD, "w").select("doc_id", "mark", "w"), "words")
    at = rows.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.posexplode("w").alias("_at", "w"))
    placed = fills.join(at, fills["doc_id"].eqNullSafe(at["_id"]) & (fills["mark"] == at["_mark"]) & (fills["at"] == at["_at"]))
    lead = F.when(F.col("glued"), F.regexp_extract("w.value", _NAME, 1)).otherwise(F.regexp_extract("w.value", _LEAD, 1))
    start = F.col("w.start") + F.length(lead)
    stop = F.col("w.start") + F.length(F.regexp_replace("w.value", r"[^\p{L}\p{N}]+$", ""))
    return placed.select("doc_id", "mark", start.alias("start"), stop.alias("stop"), "kind", "trust").where("start < stop")


def _clear(found: Column, base: Column) -> Column:
    """The found spans that meet no base span, and none before them; sorted."""
    met = lambda x, spans: F.exists(spans, lambda s: (s["start"] < x["stop"]) & (s["stop"] > x["start"]))
    clear = F.filter(found, lambda x: ~met(x, base))
    clear = F.aggregate(clear, F.array().cast(SPANS), lambda got, x: F.when(met(x, got), got).otherwise(F.concat(got, F.array(x))))
    return F.array_sort(clear)


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, base, found): found are the spans that the bootstrap adds, like base (start, kind, stop)."""
    require(docs, "doc_id", "text")
    rows = written(base_spans(docs), "base")
    seen = written(occurrences(rows), "occurrences")
    edges = graph(seen)
    sure, fills = slot_words(docs, edges, good_patterns(edges))
    key = ["doc_id", "mark", "start", "stop"]
    unseen = seen.where("kind IS NULL").select(*key, F.explode("patterns").alias("pattern"))
    unseen = unseen.join(sure, "pattern").select(*key, "kind", "trust", F.lit(False).alias("loose"))
    unseen = unseen.unionByName(loose_occurrences(docs, sure, fills).withColumn("loose", F.lit(True))).groupBy(*key, "loose")
    unseen = unseen.agg((1 - F.exp(F.sum(F.log(1 - F.least("trust", F.lit(0.999)))))).alias("score"), F.max_by("kind", F.struct("trust", "kind")).alias("kind"))
    unseen = unseen.where(F.col("score") >= MIN_SCORE)
    # A document's own spans, no more than its text has room for: shaped ones first, then from the left, the longest first.
    order = F.array_sort(F.collect_set(F.struct("loose", "start", (-F.col("stop")).alias("end"), "kind")))
    found = unseen.groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(order.alias("found"))
    found = found.withColumn("found", F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), (-x["end"]).alias("stop"))))
    same = rows["doc_id"].eqNullSafe(found["_id"]) & (rows["mark"] == found["_mark"])
    return rows.join(found, same, "left").select("doc_id", "mark", "base", _clear(F.coalesce("found", F.array().cast(SPANS)), F.col("base")).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found, n_spans): counts of kinds are of base spans, n_spans of all."""
    counts = [_count("base", n).alias(f"n_{k}") for n, k in enumerate(KINDS)]
    every = F.array_sort(F.concat("base", "found"))
    sizes = [F.size("found").cast("long").alias("n_found"), (F.size("base") + F.size("found")).cast("long").alias("n_spans")]
    return found.select("doc_id", *counts, F.sha2(_told(F.col("base")).cast("binary"), 256).alias("base_sha256"), _told(every).alias("spans"), *sizes)


def _masked(text: Column, kind: str) -> Column:
    """The text with valid matches of a kind replaced by its tag."""
    values = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    tags = F.transform(values, lambda v: F.when(valid(kind, v), F.lit(f"[{kind.upper()}]")).otherwise(v))
    return F.array_join(F.zip_with(F.split(text, PATTERNS[kind], -1), tags, lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), "")


def mask_documents(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by the tag of its kind; n_chars, if there, follows the text.

    Found spans go first; then emails, phones, cards and ips, each kind on what
    is left, so that of overlapping spans the one of the earlier kind is whole.
    Rows without a span are unchanged.
    """
    require(docs, "doc_id", "text")
    spans = find_pii(docs)
    # Everything of docs in one column, so that no name of its can clash.
    hit = spans.where("size(base) + size(found) > 0").groupBy("doc_id", "mark").agg(F.first("found").alias("found"))
    rows = docs.select(whole_row(docs).alias("row"), docs["text"].alias("text"), docs["doc_id"].alias("own"), F.xxhash64(whole_text()).alias("own_mark"))
    rows = rows.join(hit, rows["own"].eqNullSafe(hit["doc_id"]) & (rows["own_mark"] == hit["mark"]), "left")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in FOUND_KINDS])
    none = F.coalesce(F.size("found"), F.lit(0)) < 1
    # Pieces between found spans, each followed by the tag of the span after it.
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("found", lambda x: x["stop"]))
    pieces = F.zip_with(ends, "found", lambda e, x: F.concat(F.when(x.isNull(), F.col("text").substr(e + 1, F.length("text").cast("long"))).otherwise(F.col("text").substr(e + 1, x["start"] - e)), F.coalesce(F.get(names, x["kind"]), F.lit(""))))
    rows = rows.withColumn("new", F.when(none, F.col("text")).otherwise(F.array_join(pieces, "")))
    for kind in ("email", "phone", "card", "ip"):
        rows = rows.withColumn("new", F.when(F.col("mark").isNotNull(), _masked(F.col("new"), kind)).otherwise(F.col("new")))
    length = lambda c: F.length("new").cast(docs.schema[c].dataType)
    return rows.select(*[(F.col("new") if c == "text" else length(c) if c == "n_chars" else F.col("row")[c]).alias(c) for c in docs.columns])
