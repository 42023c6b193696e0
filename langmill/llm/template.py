"""Main text of web pages by deducing the template of each host.

Tokens of a page are its tags, by their path of elements, and its text nodes. Tokens of a host that
occur equally often on every page share an occurrence vector and form an equivalence class. Classes of
several tokens that cover enough pages and keep one order on all of them are the template. Classes are nested: what
stands between two tokens of a class is a gap, tokens are told apart by the gap they stand in, and those of a gap
form classes of their own, until no more are found. Text in the gaps that is no token of the template fills slots. The
host's main slot is chosen among the slots that are nested in no menu, header, footer, form and the like.
"""

from __future__ import annotations

import collections
import functools
import html as entities
import json
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from langmill.llm.spans import mix
from langmill.llm.table import ROW, pick, spread_small, staged

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[A-Za-z]+")
# Elements of HTML and names that pages give to what is no article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg".split())
INLINE = set("a abbr b bdi bdo cite code data dfn em font i ins kbd label mark q s samp small span strong strike sub sup time tt u var del".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
ASIDE_TAGS = set("head nav header footer aside form button select menu dialog object audio video canvas map".split()) | RAW
ASIDE_NAMES = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert "
    "popup modal overlay sidebar nav navbar navigation navigate menu menus breadcrumb breadcrumbs header footer copyright comment comments reply "
    "replies disqus share sharing social related recommended newsletter subscribe subscription signup login search widget toolbar pagination pager "
    "contentinfo complementary form".split()
)
MAIN_TAGS = {"article", "main"}
MAIN_NAMES = {"article", "main", "articlebody"}
_HEADINGS = {"article", "main"}


class Node:
    """An open element: its name, whether it is set aside, whether it can hold the article, its path."""

    __slots__ = ("tag", "aside", "main", "path")

    def __init__(self, tag: str, attributes: str, above: Node | None):
        named = {k.lower(): a or b or c for k, a, b, c in _NAMED.findall(attributes)} if "=" in attributes else {}
        words = {w.lower() for v in named.values() for w in _WORDS.findall(v)}
        self.tag = tag
        in_main = above is not None and above.main is not None
        own_header = tag == "header" and in_main
        self.aside = (above is not None and above.aside) or (tag in ASIDE_TAGS and not own_header) or (
            bool(words & ASIDE_NAMES) and tag not in ("html", "body") and not words & MAIN_NAMES)
        self.path = f"{above.path if above else ''}/{tag}{'.' + '.'.join(sorted(words)) if words else ''}"
        opens = not self.aside and (tag in MAIN_TAGS or bool(words & MAIN_NAMES) and tag not in ("html", "body"))
        self.main = self.path if opens else above.main if in_main and not self.aside else None


def events(page: str):
    """Text nodes and tags of a page in order: ``(kind, node, text)`` with kind open, close, break or text."""
    stack: list[Node] = []
    at, raw = 0, None
    while at < len(page):
        if raw:
            end = re.compile(rf"</{raw}\b", re.I).search(page, at)
            at, raw = (end.start() if end else len(page)), None
            continue
        m = _TOKEN.match(page, at)
        if not m:
            at += 1
            continue
        at = m.end()
        tag, text = (m[2] or "").lower(), m[4]
        if text is not None:
            yield "text", stack[-1] if stack else None, text
        elif not tag:
            continue
        elif m[1]:
            names = [n.tag for n in stack]
            if tag in names:
                keep = len(names) - 1 - names[::-1].index(tag)
                yield "close", stack[keep], tag
                del stack[keep:]
        elif tag in VOID:
            yield "break", stack[-1] if stack else None, tag
        else:
            for name in CLOSES.get(tag, {"p"} if tag not in INLINE else ()):
                if stack and stack[-1].tag == name or len(stack) > 1 and stack[-1].tag in INLINE and stack[-2].tag == name:
                    del stack[-1 if stack[-1].tag == name else -2 :]
            node = Node(tag, m[3] or "", stack[-1] if stack else None)
            yield "open", node, tag
            if not (m[3] or "").endswith("/"):
                stack.append(node)
                raw = tag if tag in RAW else None


def host_of(url: str | None) -> str:
    try:
        return urlsplit(url or "").netloc.lower()
    except ValueError:
        return ""


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


_tag_key = functools.lru_cache(1 << 14)(_key)


def token(kind: str, node: Node | None, text: str) -> int | None:
    """Key of an event of a page; line breaks, blanks and text outside all elements are no tokens."""
    if kind == "open":
        return _tag_key(f"<{node.path}")
    if kind == "close":
        return _tag_key(f">{node.path}")
    if kind == "text" and node is not None and not text.isspace():
        return _key(f"{node.path} {' '.join(text.split())}")
    return None


def page_tokens(page: str) -> tuple[list[int], list[int], list[int], list[str]]:
    """Tokens of a page in order: key, number of a path or -1, characters; and the paths.

    The path is that of the article element that a tag opens, or of the slot that a text fills.
    """
    keys, where, sizes, paths = [], [], [], {}
    for kind, node, text in events(page):
        key = token(kind, node, text)
        if key is None:
            continue
        path, size = None, 0
        if kind == "open" and node.main == node.path:
            path = node.path
        elif kind == "text" and not node.aside:
            path, size = block_path(node.path), len(" ".join(text.split()))
        keys.append(key)
        where.append(-1 if path is None else paths.setdefault(path, len(paths)))
        sizes.append(size)
    return keys, where, sizes, list(paths)


def block_path(path: str) -> str:
    """Path of the container of a text: without its paragraph, heading, list and inline elements."""
    parts = path.split("/")
    while len(parts) > 2 and (parts[-1].split(".")[0] in INLINE or re.fullmatch(r"p|h[1-6]|li|ul|ol|dl|dt|dd|pre|blockquote|td|tr|th|tbody|table", parts[-1].split(".")[0])):
        parts.pop()
    return "/".join(parts)


@functools.lru_cache(1 << 14)
def _gap(known: int, place: int) -> int:
    """Name of the gap after the first ``place`` tokens of a class."""
    return _key(f"{known} {place}")


@functools.lru_cache(64)
def _starts(classes: str | None) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Classes by the gap that they stand in and their first token."""
    return {(c["gap"], c["keys"][0]): (c["class"], c["keys"]) for c in json.loads(classes or "[]")}


class Place:
    """Where a page stands in the nested template of its host, token by token."""

    def __init__(self, classes: str | None):
        self.starts, self.open, self.gap, self.turn, self.turns = _starts(classes), [], 0, 0, 0

    def take(self, key: int) -> bool:
        """Whether the next token is the template's; else it stands in ``gap``, the page's ``turn``-th one."""
        if self.open:
            last = self.open[-1]
            known, keys, place, gap, turn = last
            if key == keys[place]:
                if place + 1 < len(keys):
                    last[2] = place + 1
                    self._enter(known, place + 1)
                else:  # the class is complete, and the gap around it goes on
                    self.open.pop()
                    self.gap, self.turn = gap, turn
                return True
        start = self.starts.get((self.gap, key))
        if start:
            self.open.append([*start, 1, self.gap, self.turn])
            self._enter(start[0], 1)
        return start is not None

    def _enter(self, known: int, place: int) -> None:
        self.turns += 1
        self.gap, self.turn = _gap(known, place), self.turns


def _longs(data: bytes | None, kind: str = "<i8") -> list[int]:
    return np.frombuffer(data or b"", dtype=kind).tolist()


def _small(hosts: DataFrame, most_hosts: int) -> DataFrame:
    return F.broadcast(hosts) if hosts.count() <= most_hosts else hosts  # a template is no larger than a page


def _streams(pages: DataFrame) -> DataFrame:
    """Staged ``host, print, keys, at, sizes, paths``: tokens of every page in order; pages of equal tokens have one print."""
    def read(batches):
        for batch in batches:
            out = []
            for page in batch.column("html").to_pylist():
                keys, where, sizes, paths = page_tokens(page or "")
                keys = np.array(keys, dtype="<i8").tobytes()
                out.append((xxhash.xxh64_intdigest(keys) - (1 << 63), keys, np.array(where, dtype="<i4").tobytes(), np.array(sizes, dtype="<i4").tobytes(), paths))
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("host"), *[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]], ["host", "print", "keys", "at", "sizes", "paths"])

    return staged(pages.select("host", "html").mapInArrow(read, "host string, print long, keys binary, at binary, sizes binary, paths array<string>"), "pages-streams")


def _counted(streams: DataFrame) -> DataFrame:
    """``host, key, pages, main``: number of different pages that each token is on, and the article element that it opens."""
    def count(batches):
        for batch in batches:
            rows, prints, keys, mains = [], [], [], []
            for host, page, data, at, sizes, paths in zip(*(batch.column(c).to_pylist() for c in ("host", "print", "keys", "at", "sizes", "paths"))):
                found = {k: paths[p] if p >= 0 and not n else None for k, p, n in zip(_longs(data), _longs(at, "<i4"), _longs(sizes, "<i4"))}
                rows += [host] * len(found)
                prints += [page] * len(found)
                keys += found.keys()
                mains += found.values()
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array(prints, pa.int64()), pa.array(keys, pa.int64()), pa.array(mains, pa.string())], ["host", "print", "key", "main"])

    found = streams.mapInArrow(count, "host string, print long, key long, main string")
    return found.groupBy("host", "key").agg(F.count_distinct("print").alias("pages"), F.max("main").alias("main"))


def _skeletons(streams: DataFrame, frequent: DataFrame, most_hosts: int) -> DataFrame:
    """Staged ``host, pages, keys, _row``: different orders of the frequent tokens on a host's pages, and on how many pages."""
    def cut(batches):
        for batch in batches:
            own = {}
            out = []
            for host, data, known in zip(*(batch.column(c).to_pylist() for c in ("host", "keys", "known"))):
                if host not in own:
                    own = {host: np.sort(np.frombuffer(known, dtype=">i8")).astype("<i8"), **(own if len(own) < 64 else {})}
                keys = np.frombuffer(data, dtype="<i8")
                out.append(keys[np.isin(keys, own[host])].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("print"), pa.array(out, pa.binary())], ["host", "print", "keys"])

    known = staged(frequent.groupBy("host").agg(F.unhex(F.array_join(F.collect_list(F.lpad(F.hex("key"), 16, "0")), "")).alias("known")), "pages-known")
    rows = streams.select("host", "print", "keys").join(_small(known, most_hosts), "host").mapInArrow(cut, "host string, print long, keys binary")
    rows = rows.groupBy("host", "keys").agg(F.count_distinct("print").alias("pages"))
    return staged(rows.withColumn(ROW, F.monotonically_increasing_id()), "pages-skeletons")


def _found(rows: DataFrame) -> DataFrame:
    """``host, gap, vector, key`` of ``host, pages, keys, _row, classes``: tokens that are in no class yet, by the gap they stand in."""
    def count(batches):
        for batch in batches:
            out = []
            for host, pages, data, row, classes in zip(*(batch.column(c).to_pylist() for c in ("host", "pages", "keys", ROW, "classes"))):
                place = Place(classes)
                found = collections.Counter((place.gap, key) for key in _longs(data) if not place.take(key))
                out += [(host, gap, key, (row * 1_000_003 + n) & (2**64 - 1), pages) for (gap, key), n in found.items()]
            columns = list(zip(*out)) or [[]] * 5
            vector = mix(np.array(columns[3], dtype=np.uint64), 5).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(vector), pa.array(columns[4], pa.int64())],
                ["host", "gap", "key", "part", "pages"])

    found = rows.mapInArrow(count, "host string, gap long, key long, part long, pages long")
    return found.groupBy("host", "gap", "key").agg(F.bit_xor("part").alias("vector"), F.sum("pages").alias("pages"))


def _ranked(rows: DataFrame) -> DataFrame:
    """``host, gap, vector, key, rank, pages, times``: tokens of ``candidates`` that have one rank within their class, in every turn of every page."""
    def rank(batches):
        for batch in batches:
            out = []
            for host, pages, data, classes, candidates in zip(*(batch.column(c).to_pylist() for c in ("host", "pages", "keys", "classes", "candidates"))):
                member, place = _members(candidates), Place(classes)
                seen, turns, ranks = collections.Counter(), {}, collections.defaultdict(list)
                for key in _longs(data):
                    if place.take(key) or (place.gap, key) not in member:
                        continue
                    vector, size = member[place.gap, key]
                    own = (place.gap, vector)
                    at = seen[own] % size
                    seen[own] += 1
                    if at == 0:
                        turns[own] = place.turn
                    ranks[place.gap, vector, key].append(at if turns[own] == place.turn else -1)
                out += [(host, *own, min(r), max(r), pages, len(r) * pages) for own, r in ranks.items()]
            columns = list(zip(*out)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if i else pa.string()) for i, x in enumerate(columns)], ["host", "gap", "vector", "key", "low", "high", "pages", "times"])

    found = rows.mapInArrow(rank, "host string, gap long, vector long, key long, low long, high long, pages long, times long")
    found = found.groupBy("host", "gap", "vector", "key").agg(F.min("low").alias("rank"), F.max("high").alias("high"), F.sum("pages").alias("pages"), F.sum("times").alias("times"))
    return found.where("rank >= 0 and rank = high").drop("high")


@functools.lru_cache(64)
def _members(candidates: str | None) -> dict[tuple[int, int], tuple[int, int]]:
    """Class and its size of the candidates' tokens, by gap and key."""
    return {(c["gap"], key): (c["vector"], len(c["keys"])) for c in json.loads(candidates or "[]") for key in c["keys"]}


def nested(skeletons: DataFrame, least: DataFrame, *, min_class: int, most_hosts: int) -> DataFrame:
    """Staged ``host, gap, class, keys``: the classes of the nested template of every host, and the gap that each stands in (0: none).

    A turn adds to every gap its first class: that on most pages, then that which occurs most rarely, so that what holds others comes
    before what is repeated in it. Tokens between those of a class are told apart by the gap from the next turn on. It ends
    when no host has found a class, after as many turns as classes stand beside and in one another.
    """
    classes = new = None
    while True:
        rows = skeletons
        if classes is None:
            rows = rows.withColumn("classes", F.lit(None).cast("string"))
        else:
            packed = classes.join(new.select("host").distinct(), "host", "left_semi").groupBy("host").agg(F.to_json(F.collect_list(F.struct("gap", "class", "keys"))).alias("classes"))
            rows = rows.join(_small(staged(packed, "pages-classes"), most_hosts), "host")
        frequent = _found(rows).join(least, "host").where("pages >= least")
        candidates = frequent.groupBy("host", "gap", "vector").agg(F.collect_list("key").alias("keys")).where(F.size("keys") >= min_class)
        candidates = staged(candidates.groupBy("host").agg(F.to_json(F.collect_list(F.struct("gap", "vector", "keys"))).alias("candidates")), "pages-candidates")
        if not candidates.head(1):
            break
        ranked = _ranked(rows.join(_small(candidates, most_hosts), "host"))
        valid = ranked.groupBy("host", "gap", "vector").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda t: t["key"]).alias("keys"), F.max("pages").alias("pages"), F.max("times").alias("times")
        ).where(F.size("keys") >= min_class)
        order = Window.partitionBy("host", "gap").orderBy(F.desc("pages"), "times", F.desc(F.size("keys")), "keys")
        best = valid.withColumn("_first", F.row_number().over(order)).where("_first = 1")
        new = staged(best.select("host", "gap", F.xxhash64("gap", "keys").alias("class"), "keys"), "pages-new-classes")
        if not new.head(1):
            break
        classes = new if classes is None else staged(classes.union(new), "pages-classes")
    return skeletons.sparkSession.createDataFrame([], "host string, gap long, class long, keys array<long>") if classes is None else classes


def deduce(pages: DataFrame, *, min_share: float = 0.5, min_pages: int = 3, min_class: int = 3, most_hosts: int = 20_000) -> DataFrame:
    """Template of every host from ``host, html``: ``host, mains, classes, slot``.

    ``classes``: the nested template (``nested``) as JSON. A class has at least ``min_class`` tokens with one occurrence vector and one order, on
    ``min_share`` of the host's pages and ``min_pages`` pages; pages of equal tokens are one page. ``mains``: paths of article elements among the
    template's tags. ``slot``: the container outside menus and the like with most text that is not the template's. The
    number of keys that reach the share is bounded by the size of a page, however many pages a host has;
    vectors are added up as fingerprints, so no host is gathered in one task.
    """
    streams = _streams(pages)
    tokens = _counted(streams)
    least = F.greatest(F.lit(min_pages), F.ceil(F.col("of") * min_share)).alias("least")
    hosts = staged(streams.groupBy("host").agg(F.count_distinct("print").alias("of")).select("host", least), "pages-hosts")
    frequent = staged(tokens.join(hosts, "host").where("pages >= least").select("host", "key", "main"), "pages-tokens")
    skeletons = _skeletons(streams, frequent, most_hosts)
    classes = nested(skeletons, hosts, min_class=min_class, most_hosts=most_hosts)
    member = classes.select("host", F.explode("keys").alias("key")).distinct()
    mains = frequent.where("main is not null").join(member, ["host", "key"], "left_semi").groupBy("host").agg(F.collect_set("main").alias("mains"))
    packed = classes.groupBy("host").agg(F.to_json(F.collect_list(F.struct("gap", "class", "keys"))).alias("classes"))
    packed = staged(packed, "pages-classes")

    def fill(batches):
        for batch in batches:
            found = collections.Counter()
            for host, data, at, sizes, paths, known in zip(*(batch.column(c).to_pylist() for c in ("host", "keys", "at", "sizes", "paths", "classes"))):
                place = Place(known)
                for key, p, size in zip(_longs(data), _longs(at, "<i4"), _longs(sizes, "<i4")):
                    if not place.take(key) and size:
                        found[host, paths[p]] += size
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in found], pa.string()), pa.array([p for _, p in found], pa.string()), pa.array(found.values(), pa.int64())], ["host", "path", "size"])

    slots = streams.drop("print").join(_small(packed, most_hosts), "host", "left").mapInArrow(fill, "host string, path string, size long")
    slots = slots.groupBy("host", "path").agg(F.sum("size").alias("size")).groupBy("host").agg(F.max(F.struct("size", "path")).alias("best"))
    found = hosts.select("host").join(mains, "host", "left").join(packed, "host", "left").join(slots, "host", "left")
    return found.select("host", "mains", "classes", F.col("best.path").alias("slot"))


def extract(page: str, mains: set[str], classes: str | None, slot: str | None) -> str:
    """Text of the main slot: that of the template's article elements, else of the page's own, else of the host's best slot.

    A page without any of them gives all its text outside menus and the like. Text of the template is left out; in an article
    only if the element around it is the template's too (a sentence that many articles share stands in a paragraph like others),
    and if it is not all that the article has.
    """
    everything = list(events(page))
    opened = {n.main for kind, n, _ in everything if kind == "open" and n.main == n.path}
    chosen = (opened & mains) or opened
    if slot and not any(k == "text" and n is not None and not n.aside and block_path(n.path).startswith(slot) for k, n, _ in everything):
        slot = None  # a page of another make than its host's others
    place, elements = Place(classes), set()
    out, fixed = [], []
    for kind, node, text in everything:
        key = token(kind, node, text)
        own = key is not None and place.take(key)
        if kind != "text":
            if own and kind == "open":
                elements.add(node)
            if node is None or text not in INLINE:
                out.append(" ")
            continue
        if node is None or node.aside:
            continue
        if chosen:
            inside = node.main in chosen or node.main is not None and any(node.path.startswith(c + "/") for c in chosen)
            if inside and own and node in elements:
                fixed.append(len(out))
        else:
            inside = (slot is None or block_path(node.path).startswith(slot)) and not own
        if inside:
            out.append(entities.unescape(text))
    left = "".join(out) if not fixed else "".join(" " if i in fixed else x for i, x in enumerate(out))
    return " ".join(left.split()) or " ".join("".join(out).split())


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_hosts: int = 20_000) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row; a null or empty page has an empty text.

    Pages of a null or odd url share the empty host. Extra columns are left out, repeated rows stay.
    """
    rows = pick(pages, id=id_col, url=url_col, html=html_col)

    def hosts(batches):
        for batch in batches:
            yield batch.append_column("host", pa.array([host_of(u) for u in batch.column("url").to_pylist()], pa.string()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    named = staged(spread_small(rows).mapInArrow(hosts, f"{schema}, host string"), "pages-rows")
    template = staged(deduce(named, most_hosts=most_hosts), "pages-template")
    joined = named.join(_small(template, most_hosts), "host", "left")

    def texts(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("html", "mains", "classes", "slot"))
            out = [extract(page or "", set(mains or ()), classes, slot) for page, mains, classes, slot in zip(*columns)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                ["id", "url", "text", "n_chars"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "url")]
    out = joined.select("id", "url", "html", "mains", "classes", "slot").mapInArrow(texts, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
