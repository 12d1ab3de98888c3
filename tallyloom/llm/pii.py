"""Personal data: fixed formats, then bootstrapped contextual extraction; DataFrame code only.

Spans of the formats are found by splitting a text at its matches, so that the lengths of what lies between give the
places. They are the seed entities. Instances are identifier-like tokens (TOKEN: eight characters or more, a digit among
them); each has patterns of three kinds: the word before its own word, its first four characters with its character
classes, and its shape (character classes with the octave of its length; letters joined to digits). Patterns and instances
form a graph. Tokens overlapped by a seed are known. Ordinary ones are the counterevidence: values that stand behind
COMMON different words or more, and addresses or card numbers that fail their check. A pattern's confidence is the share of
known among known and ordinary instances, tokens of neither kind count for nothing; a word counts as ordinary once more
for every place of the corpus where no instance follows it, so that common words never become patterns. An instance's score
is the noisy-or of its confident patterns; beyond the threshold it becomes known and makes further patterns confident, and
so on until nothing changes (known instances only grow, so it ends). Shapes carry over to values never seen before. In the
end known tokens that no format covers are spans of kind `id`.

Texts are matched on shadows of the same length in which a single separator inside a number or a host is one special
character: the patterns then have no nested repetition, which keeps very long runs from exhausting the regex stack.

Defined results: a null text is empty and has no spans. Repeated rows and ids give a row each. An empty table gives an
empty result. Places are code points, ends are exclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import checked_broadcast, durable, query

KINDS = ("email", "ip", "card", "phone", "id")
#: A pattern counts from so many known instances and from this share of them.
SUPPORT, CONFIDENCE = 5, 0.8
ACCEPT = 0.8
#: A value behind so many different words is an ordinary one.
COMMON = 4
#: Letters joined to digits are a pattern of tokens of at least so many characters.
JOINED = 16
#: Characters before a token that are searched for the word before; a longer word is no context.
NEAR = 64
_MARK = "\u0001"
_LOCAL = r"A-Za-z0-9._%+\x01-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9\x01]++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_TOKEN = "A-Za-z0-9@._+/="
TOKEN = rf"(?<![{_TOKEN}-])(?=[A-Za-z@._+/=-]*+[0-9])[{_TOKEN}-]{{8,}}+"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scanned(items: Column, item_type: str, step: Callable, view: Callable | None = None) -> Column:
    """struct<at, out> after all items: `step(at, x, seen)` gives the new place and an output of `item_type`.

    The items go in chunks of about the root of their number, so that no growing array is copied for each of them.
    `view(at, chunk)` is computed once per chunk and given to the steps as `seen`."""
    empty = F.array().cast(f"array<{item_type}>")

    def chunk(acc, part):
        def inner(seen):
            def one(a, x):
                at, out = step(a["at"], x, seen)
                return F.struct(at.alias("at"), F.concat(a["out"], F.array(out)).alias("out"))
            return F.aggregate(part, F.struct(acc["at"].alias("at"), empty.alias("out")), one)
        return _bound(view(acc["at"], part) if view else F.lit(0), inner)

    def walk(xs, width):
        none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{item_type}>>").alias("out"))
        chunks = F.aggregate(
            F.sequence(F.lit(1), F.size(xs), width), none,
            lambda acc, i: _bound(_bound(F.slice(xs, i, width), lambda part: chunk(acc, part)), lambda done: F.struct(
                done["at"].alias("at"), F.concat(acc["out"], F.array(done["out"])).alias("out"))),
            lambda acc: F.struct(acc["at"].alias("at"), F.flatten(acc["out"]).alias("out")))
        return F.when(F.size(xs) > 0, chunks).otherwise(F.struct(F.lit(0).alias("at"), empty.alias("out")))

    return _bound(items, lambda xs: _bound(F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(xs)))).cast("int"), lambda width: walk(xs, width)))


def found(text: Column, pattern: str, guard: Column) -> Column:
    """array<struct<start,end,body,before>> of the matches; `guard` says cheaply that a text can have some."""
    p = F.lit(pattern)
    bodies, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(bodies, F.slice(gaps, F.lit(1), F.size(bodies)), lambda b, g: F.struct(b.alias("body"), g.alias("before")))
    row = "struct<start:int,end:int,body:string,before:string>"

    def step(at, x, _):
        start = at + F.length(x["before"])
        end = start + F.length(x["body"])
        return end, F.struct(start.alias("start"), end.alias("end"), x["body"].alias("body"), x["before"].alias("before"))
    return F.when(guard, scanned(pairs, row, step)["out"]).otherwise(F.array().cast(f"array<{row}>"))


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc, i):
        d = digits.substr(i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when((n - i) % 2 == 1, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _ip_ok(body: Column) -> Column:
    return F.forall(F.split(body, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255))


def _card_ok(body: Column) -> Column:
    d = _digits(body)
    return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)


def _near_miss(body: Column) -> Column:
    """Four numbers that are no address, or a card's number of digits whose sum is wrong."""
    no_ip = body.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$") & ~_ip_ok(body)
    digits = F.length(_digits(body))
    return no_ip | (body.rlike("^[0-9][0-9-]+$") & digits.between(14, 19) & ~_card_ok(body))


def _ranked(spans, rank: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"], F.lit(rank).alias("rank"), x["end"]))


def with_base(docs: DataFrame) -> DataFrame:
    """Adds `base` (array<struct<start,rank,end>>, sorted) and `tokens` (identifier-like tokens without
    closing dots, with what stands before)."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), _MARK, "\u0002")
    docs = docs.withColumn("__t", text)
    t = F.col("__t")
    dots = F.regexp_replace(t, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _MARK)
    runs = F.regexp_replace(t, r"(?<=[0-9])[ -](?=[0-9])", _MARK)
    has_at, has_digit, has_plus = t.contains("@"), t.rlike("[0-9]"), t.contains("+")
    docs = docs.withColumns({
        "__dots": F.when(has_at, dots).otherwise(""), "__runs": F.when(has_digit, runs).otherwise("")})
    docs = docs.withColumns({
        "__email": found(F.col("__dots"), EMAIL, has_at), "__ip": found(t, IP, has_digit),
        "__card": found(F.col("__runs"), CARD, has_digit), "__phone": found(t, PHONE, has_plus), "tokens": found(t, TOKEN, has_digit)})
    good = [
        F.col("__email"), F.filter("__ip", lambda x: _ip_ok(x["body"])), F.filter("__card", lambda x: _card_ok(x["body"])),
        F.filter("__phone", lambda x: F.length(_digits(x["body"])).between(10, 15))]
    base = F.concat(*[_ranked(a, r) for r, a in enumerate(good)])
    near = lambda x: F.when(F.length(x) > NEAR, F.right(x, F.lit(NEAR))).otherwise(F.concat(F.lit(" "), x))
    tokens = F.transform("tokens", lambda x: F.struct(
        x["start"], (x["end"] - F.length(x["body"]) + F.length(F.rtrim(x["body"], F.lit(".")))).alias("end"),
        F.rtrim(x["body"], F.lit(".")).alias("body"), F.lower(near(x["before"])).alias("before")))
    return docs.withColumns({"base": F.array_sort(base), "tokens": tokens}).drop("__t", "__dots", "__runs", "__email", "__ip", "__card", "__phone")


def occurrences(rows: DataFrame) -> DataFrame:
    """(rid, start, end, instance, word, seed, near_miss, patterns): a row per identifier-like token.

    A token is a seed if a base span overlaps it: of the spans that start before its end, one ends behind its start."""
    none = lambda kind: F.lit(None).cast(kind)
    tokens = rows.select("rid", F.explode("tokens").alias("t")).select(
        "rid", F.col("t.end").alias("place"), F.lit(0).alias("of_base"), "t.start", "t.body", "t.before", none("int").alias("reach"))
    spans = rows.select("rid", F.explode("base").alias("b")).select(
        "rid", F.col("b.start").alias("place"), F.lit(1).alias("of_base"), none("int").alias("start"), none("string").alias("body"),
        none("string").alias("before"), F.col("b.end").alias("reach"))
    so_far = Window.partitionBy("rid").orderBy("place", "of_base").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = tokens.unionAll(spans).withColumn("reach", F.max("reach").over(so_far)).filter("of_base = 0").withColumn(
        "seed", F.coalesce(F.col("reach") > F.col("start"), F.lit(False)))
    word = F.regexp_extract("before", r"\s(\S+)\s+\S*$", 1)
    body = F.col("body")
    classes = F.concat(*[F.when(body.rlike(p), name).otherwise("") for name, p in (("a", "[a-z]"), ("A", "[A-Z]"), ("9", "[0-9]"), (".", "[^A-Za-z0-9]"))])
    head = F.left(body, F.lit(4))
    patterns = F.array(
        F.when(word != "", F.concat(F.lit("word|"), word)),
        F.when(~head.rlike("[0-9]"), F.concat(F.lit("head|"), F.lower(head), F.lit("|"), classes)),
        F.concat(F.lit("shape|"), classes, F.lit("|"), F.floor(F.log2(F.length(body))).cast("string")),
        F.when((F.length(body) >= JOINED) & body.rlike("[A-Za-z][0-9]|[0-9][A-Za-z]"), F.lit("joined")))
    return one.select(
        "rid", "start", F.col("place").alias("end"), F.lower(body).alias("instance"), word.alias("word"), "seed",
        (_near_miss(body) & ~F.col("seed")).alias("near_miss"), F.array_compact(patterns).alias("patterns"))


def lone_words(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """(pattern, elsewhere): how often the word of a pattern stands where no identifier-like token follows."""
    used = durable(tokens.filter("word <> ''").groupBy("word").agg(F.count("*").alias("used")).filter(F.col("used") >= SUPPORT))
    few = checked_broadcast(used, used.count())
    words = texts.select(F.explode(F.split(F.lower(F.col("text")), r"\s+")).alias("word")).join(few.select("word"), "word", "left_semi")
    counts = words.groupBy("word").agg(F.count("*").alias("n")).join(used, "word")
    return durable(counts.select(F.concat(F.lit("word|"), "word").alias("pattern"), F.greatest(F.col("n") - F.col("used"), F.lit(0)).alias("elsewhere")))


def known_instances(tokens: DataFrame, elsewhere: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known instances, confident patterns) at the fixed point; each round's tables are written."""
    contexts = tokens.groupBy("instance", "word").agg(F.max("seed").alias("seed"), F.max("near_miss").alias("near_miss"))
    nodes = contexts.groupBy("instance").agg(F.max("seed").alias("seed"), F.max("near_miss").alias("near_miss"), F.count("*").alias("n"))
    nodes = durable(nodes.select("instance", "seed", (~F.col("seed") & (F.col("near_miss") | (F.col("n") >= COMMON))).alias("ordinary")))
    edges = tokens.select("instance", F.explode("patterns").alias("pattern")).distinct()
    edges = durable(edges.join(nodes.select("instance", "ordinary"), "instance"))
    against = edges.groupBy("pattern").agg(F.sum(F.col("ordinary").cast("long")).alias("against"))
    against = durable(against.join(elsewhere, "pattern", "left").select("pattern", (F.col("against") + F.coalesce("elsewhere", F.lit(0))).alias("against")))
    known, n_known = durable(nodes.filter("seed").select("instance")), -1
    while (n := known.count()) > n_known:
        n_known = n
        good = edges.join(known, "instance", "left_semi").groupBy("pattern").agg(F.count("*").alias("good")).filter(F.col("good") >= SUPPORT)
        patterns = good.join(against, "pattern").filter(F.col("good") >= CONFIDENCE * (F.col("good") + F.col("against")))
        patterns = durable(patterns.select("pattern", (F.col("good") / (F.col("good") + F.col("against") + 1.0)).alias("confidence")))
        scored = edges.filter("not ordinary").join(checked_broadcast(patterns, patterns.count()), "pattern").groupBy("instance").agg(
            (1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        known = durable(known.unionAll(scored.filter(F.col("score") >= ACCEPT).select("instance")).distinct())
    return known, patterns


def discovered(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(rid, more): spans of kind `id` for the rows that have some; `texts` has the whole texts of the rows."""
    tokens = durable(occurrences(rows))
    known, _ = known_instances(tokens, lone_words(texts, tokens))
    hits = tokens.filter("not seed and not near_miss").join(known, "instance", "left_semi").select("rid", "start", "end").distinct()
    return hits.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", F.lit(4).alias("rank"), "end"))).alias("more"))


def named(spans: Column) -> Column:
    kind = lambda r: F.element_at(F.array(*[F.lit(k) for k in KINDS]), r + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _all(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds `spans`, the base ones and the discovered ones by place."""
    more = durable(discovered(rows, texts))
    out = rows.join(checked_broadcast(more, more.count()), "rid", "left")
    return out.withColumn("spans", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,rank:int,end:int>>"))))).drop("more")


def spans_of(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, counts by kind, base_sha256 and all spans, the number of discovered and of all spans."""
    rows = durable(with_base(docs.select("doc_id", "text")).select("doc_id", "base", "tokens", F.monotonically_increasing_id().alias("rid")))
    count = lambda r: F.size(F.filter("base", lambda x: x["rank"] == r)).cast("long")
    return _all(rows, docs.select("text")).select(
        "doc_id", *[count(r).alias(f"n_{k}") for r, k in enumerate(KINDS[:4])], F.sha2(named(F.col("base")), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_id"), F.size("spans").cast("long").alias("n_spans"))


def masked(docs: DataFrame) -> DataFrame:
    """`docs` with each span replaced by its kind in angle brackets and `n_chars` of the new text; overlapping spans go as one."""
    rows = with_base(docs.select(F.struct("*").alias("row"), "text")).drop("text").withColumn("rid", F.monotonically_increasing_id())
    text = F.col("row.text")
    kind = lambda r: F.element_at(F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS]), r + 1)

    def view(at, chunk):
        """The text from `at` to the last end of a chunk of spans, so that short cuts do not walk the whole text."""
        end = F.greatest(at, F.array_max(F.transform(chunk, lambda x: x["end"])))
        return F.struct(at.alias("from"), text.substr(at + 1, end - at).alias("text"))

    def cut(at, x, seen):
        fresh = x["start"] >= at
        piece = F.concat(seen["text"].substr(at - seen["from"] + 1, x["start"] - at), kind(x["rank"]))
        return F.greatest(at, x["end"]), F.when(fresh, piece).otherwise("")
    done = _bound(scanned(F.col("spans"), "string", cut, view), lambda x: F.concat(
        F.array_join(x["out"], ""), text.substr(x["at"] + 1, F.length(text))))
    rows = _all(durable(rows), docs.select("text")).withColumn("new", F.when(F.size("spans") > 0, done).otherwise(text))
    return rows.select(F.col("row").withField("text", F.col("new")).withField("n_chars", F.length("new").cast("long")).alias("row")).select("row.*")


@query("op9_pii")
def _op9(table):
    return spans_of(table("documents"))
