"""HTML extraction with wrappers: union-free regular expressions over the blocks of same-host pages.

A page becomes a stream of slots: text blocks named by the path of elements around them. Within a page, neighbouring
equal groups of slots fold into repeated ones. Same-host streams are then aligned one after the other: slots both have
stay, a slot that one lacks becomes optional, one that repeats in either is repeated, and texts that differ turn a slot
from a constant into a variable one. Equal streams are counted before the alignment, and the streams of a host are
aligned in salted groups of bounded size whose wrappers are aligned again, so a host with a third of all pages is spread.
Each page is then matched to its host's wrapper: a block belongs to a place of the expression, so equal paths at different
places are different slots. In a slot the blocks are counted from both ends; those that are equal on all pages having them,
up to the first that varies, are constant. The main text of a page is that in article elements, else its variable blocks
outside of menus, headers, footers, sidebars, notices, adverts, forms and comments.

Defined results: a null page is empty; a page without such slots has an empty text. A null url or one without host
belongs to the host ''. Repeated rows give a row each. An empty table gives an empty result."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import lru_cache
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import checked_broadcast, durable, query, small_batches
from tallyloom.llm.urls import host

#: Streams that one alignment task folds; more are folded in levels.
FOLD = 500
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_BOILER = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "svg", "object", "canvas", "dialog", "menu", "fieldset", "audio", "video", "math", *_RAW}
_MAIN = {"article", "main"}
_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "notice", "notices",
    "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "sidebar", "side", "widget", "footer", "header", "masthead", "share", "social", "related", "comment", "comments", "reply", "replies", "disqus",
    "complementary", "contentinfo", "search", "login", "pagination"}
#: An element of these names closes an open one of the same set that it stands in directly.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|<[A-Za-z/!?][^>]*+>""", re.S)
_HINT = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


def _is_boiler(name: str, attrs: str, in_main: bool) -> bool:
    if name in _BOILER or (name == "header" and not in_main):
        return True
    if not attrs or name in ("html", "body") or name in _MAIN and not re.search("comment|repl", attrs, re.I):
        return False
    return any(w in _WORDS for hint in _HINT.findall(attrs) for w in re.split(r"[\W_]+", hint.lower()))


def blocks(page: str | None) -> Iterator[tuple[str, str]]:
    """(path, text) of each block outside of boilerplate elements; white space is one space, references are decoded."""
    page = page or ""
    open_, skip, at, parts = [], 0, 0, []  # skip: open elements up to the boilerplate one
    path = ""

    def closed():
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        return text

    def shut(depth):
        nonlocal skip
        del open_[depth:]
        if len(open_) < skip:
            skip = 0

    end = len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        stop = found.start() if found else end
        if stop > at and not skip:
            parts.append(page[at:stop])
        if not found:
            break
        at, name = found.end(), (found["name"] or "").lower()
        if not name:
            continue
        if name not in _INLINE or skip:
            if not skip:
                text = closed()
                if text:
                    yield path, text
        elif name == "br":
            parts.append(" ")
        if found["close"]:
            if name in open_:
                if name not in _INLINE or name in open_[max([i + 1 for i, n in enumerate(open_) if n not in _INLINE], default=0):]:
                    shut(len(open_) - 1 - open_[::-1].index(name))
        elif name not in _VOID:
            attrs = found["attrs"] or ""
            block = name not in _INLINE
            if block and not skip and open_:
                last = max((i for i, n in enumerate(open_) if n not in _INLINE), default=-1)
                if last >= 0 and open_[last] in _CLOSES.get(name, ()) or last >= 0 and open_[last] == "p":
                    shut(last)
            if not attrs.endswith("/") or block:
                open_.append(name)
                if not skip and _is_boiler(name, attrs, any(n in _MAIN for n in open_[:-1])):
                    skip = len(open_)
                if name in _RAW:
                    ended = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                    at = ended.end() if ended else end
                    shut(len(open_) - 1)
        path = "/".join(n for n in open_ if n not in _INLINE)
    if not skip:
        text = closed()
        if text:
            yield path, text


def grouped(slots: Sequence[str], widest: int = 4) -> tuple[list[str], list[list[int]]]:
    """Neighbouring equal groups become one group of repeated slots (`+`); with the numbers of each slot's blocks."""
    out: list[str] = []
    members: list[list[int]] = []
    for i, s in enumerate(slots):
        out.append(s)
        members.append([i])
        again = True
        while again:
            again = False
            for n in range(1, min(widest, len(out) // 2) + 1):
                if [x.rstrip("+") for x in out[-n:]] == [x.rstrip("+") for x in out[-2 * n:-n]]:
                    out[-2 * n:] = [x.rstrip("+") + "+" for x in out[-n:]]
                    for k in range(n):
                        members[-2 * n + k] += members[-n + k]
                    del members[-n:]
                    again = True
                    break
    return out, members


def folded(slots: Sequence[str], widest: int = 4) -> list[str]:
    return grouped(slots, widest)[0]


def aligned(a: list[str], b: list[str]) -> list[str]:
    """The union-free expression of two: `?` marks optional slots, `+` repeated ones."""
    name = lambda x: x.rstrip("+?")
    optional = lambda xs: [name(x) + ("+" if "+" in x else "") + "?" for x in xs]
    out: list[str] = []
    for kind, i, j, k, m in SequenceMatcher(None, [name(x) for x in a], [name(x) for x in b], autojunk=False).get_opcodes():
        if kind == "equal":
            out += [name(x) + ("+" if "+" in x + y else "") + ("?" if "?" in x + y else "") for x, y in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += optional(a[i:j]) + optional(b[k:m])
    return folded_optional(out)


def folded_optional(slots: list[str]) -> list[str]:
    out: list[str] = []
    for s in slots:
        if out and out[-1].rstrip("+?") == s.rstrip("+?"):
            out[-1] = s.rstrip("+?") + "+" + ("?" if "?" in s and "?" in out[-1] else "")
        else:
            out.append(s)
    return out


_SEEN = T.StructType([
    T.StructField("stream", T.ArrayType(T.StringType())), T.StructField("names", T.ArrayType(T.StringType())), T.StructField("texts", T.ArrayType(T.LongType()))])
_SLOT = T.ArrayType(T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("text", T.LongType())]))


def _hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode(errors="replace")) - (1 << 63)


@F.pandas_udf(_SEEN)
def page_stream(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in parts:
        out = []
        for page in part:
            found = list(blocks(page))
            names = [path for path, _ in found]
            out.append((folded(names), names, [_hashed(text) for _, text in found]))
        yield pd.DataFrame(out, columns=["stream", "names", "texts"])


@lru_cache(256)
def _matcher(wrapper: tuple[str, ...]) -> tuple[SequenceMatcher, dict[str, list[int]]]:
    places: dict[str, list[int]] = {}
    names = [x.rstrip("+?") for x in wrapper]
    for i, x in enumerate(names):
        places.setdefault(x, []).append(i)
    return SequenceMatcher(None, [], names, autojunk=False), places


@lru_cache(4096)
def placed(names: tuple[str, ...], wrapper: tuple[str, ...]) -> list[list[tuple[int, int, int]]]:
    """Blocks of a page by slot of its host's wrapper: (slot, place from the start, place from the end, counted as -1, -2, ...)."""
    slots, members = grouped(names)
    matcher, places = _matcher(wrapper)
    slots = [x.rstrip("+") for x in slots]
    matcher.set_seq1(slots)
    where = [-1] * len(slots)
    for a, b, n in matcher.get_matching_blocks():
        where[a:a + n] = range(b, b + n)
    last = 0
    held: dict[int, list[int]] = {}
    for i, s in enumerate(slots):
        if where[i] < 0 and s in places:  # the next slot of that name, or else the nearest
            where[i] = next((x for x in places[s] if x >= last), places[s][-1])
        last = max(last, where[i])
        held.setdefault(where[i], []).extend(members[i])
    out: list[tuple[int, int, int]] = [(-1, 0, -1)] * len(names)
    for slot, numbers in held.items():
        for k, i in enumerate(sorted(numbers)):
            out[i] = (slot, k, k - len(numbers))
    return out


@F.pandas_udf(_SLOT)
def page_slots(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for names, texts, wrappers_ in parts:
        out = []
        for n, t, w in zip(names, texts, wrappers_, strict=True):
            found = placed(tuple(n), tuple(w))
            out.append([{"slot": s, "at": at, "text": x} for (s, *ends), x in zip(found, t, strict=True) for at in ends])
        yield pd.Series(out)


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    streams = sorted((list(x) for x in pdf["stream"]), key=lambda x: (len(x), x))
    wrapper = streams[0]
    for s in streams[1:]:
        wrapper = aligned(wrapper, s)
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "stream": [wrapper]})


def wrappers(streams: DataFrame) -> DataFrame:
    """(host, stream): one expression per host from the distinct streams of its pages; groups are bounded by FOLD."""
    now = durable(streams.select("host", "stream").distinct())
    while True:
        sizes = durable(now.groupBy("host").agg(F.count("*").alias("n")))
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return now
        salted = now.join(checked_broadcast(sizes, sizes.count()), "host").withColumn(
            "salt", F.pmod(F.xxhash64("stream"), F.ceil(F.col("n") / FOLD)))
        now = durable(salted.groupBy("host", "salt").applyInPandas(_fold, "host string, stream array<string>"))


def constants(slots: DataFrame) -> DataFrame:
    """(host, constant): places in the slots of a host's wrapper that hold one text on all pages, from the slots of its pages."""
    texts = slots.groupBy("host", "slot", "at").agg(F.min("text").alias("low"), F.max("text").alias("high"), F.count("*").alias("n"))
    same = texts.filter("slot >= 0 and n > 1 and low = high")
    return same.groupBy("host").agg(F.sort_array(F.collect_set(F.struct("slot", "at"))).alias("constant"))


def _variable(places: list[tuple[int, int, int]], constant: set[tuple[int, int]]) -> list[bool]:
    """Whether each block varies: it is not in the run of constant places at the start or the end of its slot."""
    starts: dict[int, int] = {}
    ends: dict[int, int] = {}
    for found, one, step in ((starts, 0, 1), (ends, -1, -1)):
        for slot in {p[0] for p in places}:
            at = one
            while (slot, at) in constant:
                at += step
            found[slot] = at
    return [k >= starts[s] and e <= ends[s] for s, k, e in places]


@F.pandas_udf(T.StringType())
def page_text(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for pages, wrappers_, constant in parts:
        out = []
        for page, wrapper, fixed in zip(pages, wrappers_, constant, strict=True):
            found = list(blocks(page))
            texts = [t for p, t in found if not _MAIN.isdisjoint(p.split("/"))]
            if not texts and found:
                places = placed(tuple(p for p, _ in found), tuple(wrapper))
                known = set() if fixed is None else {(x["slot"], x["at"]) for x in fixed}
                texts = [t for (_, t), varies in zip(found, _variable(places, known), strict=True) if varies]
            out.append("\n".join(texts))
        yield pd.Series(out, dtype=object)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages`."""
    rows = small_batches(pages.select("page_id", "url", "html", host(F.col("url")).alias("host")))
    seen = durable(rows.select("host", page_stream("html").alias("s")).select("host", "s.*").filter(F.size("stream") > 0))
    found = wrappers(seen)
    n_hosts = found.count()
    # copies of a page count once: only pages that differ show what is constant
    different = durable(seen.select("host", "names", "texts").distinct())
    placed_ = different.join(checked_broadcast(found, n_hosts), "host").select("host", F.explode(page_slots("names", "texts", "stream")).alias("s"))
    known = durable(constants(placed_.select("host", "s.*")))
    out = rows.join(checked_broadcast(found.join(known, "host", "left"), n_hosts), "host", "left")
    out = out.select("page_id", "url", page_text("html", "stream", "constant").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


@query("op10_html")
def _op10(table):
    return extracted(table("pages"))
