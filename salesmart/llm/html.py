"""Main text of web pages by equivalence classes of template tokens.

The pages of a host are made from a template. Tokens (tags with the elements around them,
and whole text runs) that occur equally often on every page of a host belong to one class:
they come from the same part of the template. A class is valid if its tokens stand in the
same order on every page and no other class straddles one of them; others are broken up or
left out. One token may serve several ends: occurrences that stand at different places of
the valid classes get roles of their own, and classes are made from the roles again, until
no role is split. Then all classes are nested at fixed places, which is the template; what
stands between its tokens are the slots. The main text is what the slots of the article's
element hold, without the elements nested in it that serve other ends. Vectors of
occurrences are compared by fingerprints that add up over pages, so that no task ever holds
a host's pages.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache, partial, reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmart.llm.bpe import slices
from salesmart.llm.stored import settle, settle_alone

# Names of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
CLOSED_BY = {  # an open element that ends where one of these begins
    "p": set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre search section table ul".split()),
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
    "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "head": {"body"},
}
SCOPES = {"table", "td", "th", "ul", "ol", "dl", "select", "article", "section", "div", "body", "html"}

# Elements, roles and class or id words that mark what is not the article.
OTHER = set("head nav footer aside form script style noscript template button select textarea iframe object svg dialog menu menuitem search".split())
OUTSIDE = {"header"}  # only around the article; inside, it holds the article's own heading
OTHER_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
OTHER_WORDS = set(
    "ad ads adv advert advertisement advertisements sponsor sponsored promo banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer comment comments disqus reply replies cookie cookies consent notice notices notification newsletter subscribe popup modal related share sharing social widget".split()
)
MAIN = ("article", "main")

MOST_PAGES = 0.5  # share of a host's pages that a class of the template covers at least
CONSTANT_PAGES = 10  # pages from which on equal text outside articles is taken for the template's
HELD = 50_000  # sums that a task holds before it passes them on

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*\Z",  # cut off
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
WORD = re.compile(r"[a-z0-9]+")


@lru_cache(maxsize=1 << 14)
def _element(name: str, attributes: str) -> tuple[str, str, bool]:
    """Label, kind of main element (or none) and whether it serves other ends, of an element by its tag alone."""
    told = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
    marks = [told[k] for k in ("id", "class", "role") if k in told]
    role = told.get("role", "")
    words = {w for k in ("id", "class") for w in WORD.findall(told.get(k, ""))}
    main = name if name in MAIN else "main" if role == "main" else ""
    marked = bool(words & OTHER_WORDS) or role in OTHER_ROLES
    return ".".join([name, *marks]), main, name in OTHER or marked and not main and name not in ("html", "body")


class Element:
    __slots__ = ("name", "path", "other", "outside", "main")

    def __init__(self, name: str, attributes: str, parent: "Element | None") -> None:
        self.name = name
        # long attributes (data, whole images) aren't worth remembering
        label, self.main, self.other = (_element if len(attributes) < 200 else _element.__wrapped__)(name, attributes)
        around = parent.path if parent else ""
        self.path = around if name in INLINE else f"{around}/{label}"
        self.outside = name in OUTSIDE


def tokens(page: str) -> Iterator[tuple[str, str, list[Element]]]:
    """Kind (``<``, ``>`` or ``""`` for text), text and the open elements, of a page as a browser nests it.

    An opening tag's list ends with its element; so does a closing tag's. Comments and what
    scripts and styles hold are left out.
    """
    stack: list[Element] = []
    at = 0

    def pop_to(depth: int) -> Iterator[tuple[str, str, list[Element]]]:
        while len(stack) > depth:
            yield ">", "", stack
            stack.pop()

    while at < len(page):
        tag = TAG.search(page, at)
        if tag is None:
            yield "", page[at:], stack
            break
        if tag.start() > at:
            yield "", page[at : tag.start()], stack
        at = tag.end()
        if tag.group(2) is None:
            continue
        name = tag.group(2).lower()
        if tag.group(1):
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), None)
            if depth is not None and (name not in INLINE or not any(e.name not in INLINE for e in stack[depth:])):
                yield from pop_to(depth)
            continue
        for i in range(len(stack) - 1, -1, -1):
            closers = CLOSED_BY.get(stack[i].name)
            if closers and name in closers:
                yield from pop_to(i)
                break
            if stack[i].name in SCOPES:
                break
        element = Element(name, tag.group(3), stack[-1] if stack else None)
        stack.append(element)
        yield "<", "", stack
        if name in VOID or tag.group(3).endswith("/") and name not in RAW and name not in INLINE and name not in ("p", "div", "article", "main", "section", "body"):
            yield ">", "", stack
            stack.pop()
        elif name in RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>]|\\Z)", re.I).search(page, at)
            if name not in ("script", "style"):
                yield "", page[at : end.start() if end else len(page)], stack
            at = end.start() if end else len(page)
    yield from pop_to(0)


def _fingerprint(*parts: str) -> int:
    return int.from_bytes(blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _tidy(text: str) -> str:
    return " ".join(html.unescape(text).split())


@lru_cache(maxsize=1 << 16)
def _tag_number(kind: str, path: str) -> int:
    return _fingerprint(kind, path, "")


def _number(kind: str, text: str, stack: Sequence[Element]) -> int | None:
    """A token's number, of its kind, the elements around it and its text; none for inline tags and white space."""
    if kind:
        return None if stack[-1].name in INLINE else _tag_number(kind, stack[-1].path)
    text = _tidy(text)
    return _fingerprint("", stack[-1].path if stack else "", text) if text else None


def _tokenised(pages: DataFrame) -> DataFrame:
    """Per page its tokens' numbers and lengths (0: tags) in order; marks of tags come with the first page of a batch that has them."""
    schema = "host string, row bigint, tokens array<bigint>, lengths array<int>, tags array<struct<token: bigint, mark: string, main: string>>"
    tag = pa.struct([("token", pa.int64()), ("mark", pa.string()), ("main", pa.string())])
    kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(tag)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, 2):
            rows, known = [], set()
            for page_id, host, page in zip(*(c.to_pylist() for c in some.columns)):
                numbers, lengths, tags = [], [], []
                for kind, text, stack in tokens(page or ""):
                    if (number := _number(kind, text, stack)) is None:
                        continue
                    numbers.append(number)
                    lengths.append(0 if kind else len(text))
                    if kind and (host, number) not in known:
                        known.add((host, number))
                        tags.append((number, kind + stack[-1].path, stack[-1].main if kind == "<" else ""))
                told = [dict(zip(("token", "mark", "main"), t)) for t in tags]
                rows.append((host, _fingerprint(str(page_id), page or ""), numbers, lengths, told))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["host", "row", "tokens", "lengths", "tags"])

    return pages.mapInArrow(run, schema)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Host, row, tokens and what follows of each page; only one page's tokens are Python's at a time."""
    column = batch.column(2)
    numbers = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False)).tolist()
    start = 0
    for host, row, end, *more in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends, *(c.to_pylist() for c in batch.columns[3:])):
        yield host, row, numbers[start:end].tolist(), *more
        start = end


OUTSIDE_ALL = (0, 0)  # the slot around all classes


class Template:
    """The classes of one round: what is looked up for each token of a page."""

    def __init__(self, told: str) -> None:
        self.classes = json.loads(told)
        self.frequent = {r for c in self.classes for r in c["roles"]}
        nested = [c["roles"] for c in self.classes if c["nested"]]
        self.places = {r: (roles[0], i, len(roles) - 1) for roles in nested for i, r in enumerate(roles)}
        self.indexes = {r: (i, j) for i, c in enumerate(self.classes) for j, r in enumerate(c["roles"])}
        self.ends: dict[int, int] = {}  # tags that open main elements, and those that close them
        for c in self.classes:
            for i, (role, mark, main) in enumerate(zip(c["roles"], c["marks"], c["mains"])):
                end = f">{mark[1:]}"
                if main and c["nested"] and end in c["marks"][i:]:
                    self.ends[role] = c["roles"][c["marks"].index(end, i)]

    def slots(self, roles: Iterable[int | None]) -> list[tuple[int, int]]:
        """The slot in which each token stands: a class, told by its first role, and the place in it."""
        stack: list[tuple[int, int]] = []
        out = []
        for role in roles:
            at = self.places.get(role)
            if at is None:
                out.append(stack[-1] if stack else OUTSIDE_ALL)
                continue
            first, place, last = at
            if place:
                while stack and stack[-1][0] != first:
                    stack.pop()
                if stack:
                    stack.pop()
            out.append(stack[-1] if stack else OUTSIDE_ALL)
            if place < last:
                stack.append((first, place))
        return out


@lru_cache(maxsize=256)
def read_round(told: str) -> Template:
    return Template(told)


@lru_cache(maxsize=1 << 16)
def _role(role: int, slot: tuple[int, int]) -> int:
    return role if slot == OUTSIDE_ALL else _fingerprint("role", *map(str, (role, *slot)))


def roles_of(numbers: Sequence[int], rounds: Sequence[str]) -> list[int | None]:
    """Roles of a page's tokens after these rounds; none where too few pages of the host have the role to be its template's."""
    roles: list[int | None] = list(numbers)
    for told in rounds:
        template = read_round(told)
        roles = [_role(r, slot) if r in template.frequent else None for r, slot in zip(roles, template.slots(roles))]
    return roles


def _role_counts(tokenised: DataFrame, hosts: DataFrame) -> DataFrame:
    """Per host and role: its token, the pages that have it, how often in all, and its fingerprint of occurrences."""
    schema = "host string, role bigint, token bigint, host_pages bigint, pages bigint, times bigint, low bigint, high bigint, place bigint"
    names = schema.replace(" bigint", "").replace(" string", "").split(", ")
    kinds = [pa.string(), *[pa.int64()] * 8]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int, int], list[int]] = {}

        def passed_on() -> pa.RecordBatch:
            rows = [(*key, *told) for key, told in sums.items()]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for host, row, numbers, host_pages, rounds in _rows(batch):
                roles = roles_of(numbers, rounds)
                first: dict[int, tuple[int, int]] = {}
                for place, (role, number) in enumerate(zip(roles, numbers)):
                    if role is not None and role not in first:
                        first[role] = (place, number)
                seen = Counter(roles)
                for role, (place, number) in first.items():
                    told = sums.setdefault((host, role, number, host_pages), [0, 0, 0, 0, 0])
                    vector = _fingerprint(str(row), str(seen[role]))
                    for i, more in enumerate((1, seen[role], vector & 0xFFFFFFFF, (vector >> 32) & 0xFFFFFFFF, place)):
                        told[i] += more
                if len(sums) >= HELD:
                    yield passed_on()
        if sums:
            yield passed_on()

    counted = tokenised.select("host", "row", "tokens").join(hosts.select("host", "host_pages", "rounds"), "host").mapInArrow(run, schema)
    return counted.groupBy("host", "role", "token", "host_pages").agg(*(F.sum(n).alias(n) for n in names[4:]))


def _classes(counted: DataFrame, marks: DataFrame) -> DataFrame:
    """Per host its classes, the most frequent first, as JSON, and the number of roles in them."""
    frequent = counted.where(F.col("pages") >= F.col("host_pages") * MOST_PAGES).join(marks, ["host", "token"], "left")
    told = F.struct((F.col("place") / F.col("pages")).alias("place"), "role", F.coalesce("mark", F.lit("=")).alias("mark"), F.coalesce("main", F.lit("")).alias("main"))
    classes = frequent.groupBy("host", "pages", "times", "low", "high").agg(F.array_sort(F.collect_list(told)).alias("members"))
    one = F.struct(
        (-F.col("pages")).alias("rank"), F.col("members")[0]["place"].alias("place"), "pages", "times",
        F.col("members.role").alias("roles"), F.col("members.mark").alias("marks"), F.col("members.main").alias("mains"),
        (F.size("members") > 1).alias("nested"),
    )
    return classes.groupBy("host").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("template"), F.sum(F.size("members")).alias("n_roles"))


def _turns(order: list[int], size: int) -> set[int]:
    """Places before which a class is to be cut so that on this page each part's tokens take turns."""
    if order == list(range(size)) * (len(order) // size):
        return set()
    at: list[list[int]] = [[] for _ in range(size)]
    for i, place in enumerate(order):
        at[place].append(i)
    cuts = set()
    for place, (a, b) in enumerate(zip(at, at[1:]), start=1):
        if not (len(a) == len(b) and all(x < y for x, y in zip(a, b)) and all(y < x for y, x in zip(b, a[1:]))):
            cuts.add(place)
    part = np.cumsum([place in cuts for place in range(size)]).tolist()
    held: dict[int, list[int]] = defaultdict(list)
    for place in order:
        held[part[place]].append(place)
    for places in held.values():
        whole = sorted(set(places))
        if places != whole * (len(places) // len(whole)):
            cuts.update(whole[1:])
    return cuts


def _disorders(roles: Sequence[int | None], template: Template) -> Iterator[tuple[int, int]]:
    """Classes whose tokens don't take turns on a page, with the places to cut them."""
    order: dict[int, list[int]] = defaultdict(list)
    for role in roles:
        if at := template.indexes.get(role):
            order[at[0]].append(at[1])
    for i, found in order.items():
        for place in _turns(found, len(template.classes[i]["roles"])):
            yield i, place


def ordered(classes: list[dict], cuts: list[dict], together: bool = False) -> list[dict]:
    """Classes cut so that they are in order on every page; ``together``: tags of one element stay so, to be checked again."""
    places = defaultdict(set)
    for cut in cuts:
        places[cut["a"]].add(cut["b"])
    out = []
    for i, told in enumerate(classes):
        ends = [0, *sorted(places[i]), len(told["roles"])]
        parts = [list(range(a, b)) for a, b in zip(ends, ends[1:])]
        alone: dict[str, list[int]] = defaultdict(list)
        for (place,) in (p for p in parts if len(p) == 1):
            mark = told["marks"][place]
            alone[mark[1:] if together and mark[1:] else f"={place}"].append(place)
        parts = [p for p in parts if len(p) > 1] + list(alone.values())
        for part in sorted(parts):
            out.append(told | {k: [told[k][j] for j in part] for k in ("roles", "marks", "mains")} | {"nested": len(part) > 1})
    return out


def _straddles(roles: Sequence[int | None], template: Template) -> Iterator[tuple[int, int]]:
    """Pairs of classes one of which begins in a slot of the other and isn't at its end where the slot ends."""
    stack: list[int] = []
    for role in roles:
        if (at := template.places.get(role)) is None:
            continue
        _, place, last = at
        i = template.indexes[role][0]
        if not place:
            stack.append(i)
            continue
        depth = len(stack) - 1 - stack[::-1].index(i)
        for other in stack[depth + 1 :]:
            yield min(i, other), max(i, other)
        if place == last:
            del stack[depth]


def nested(classes: list[dict], straddles: list[dict]) -> list[dict]:
    """Of two classes that aren't nested in each other, only the one on more pages is the template's."""
    against = defaultdict(set)
    for pair in straddles:
        against[pair["b"]].add(pair["a"])
    kept: set[int] = set()
    for i, told in enumerate(classes):
        if told["nested"] and not against[i] & kept:
            kept.add(i)
    return [told | {"nested": i in kept} for i, told in enumerate(classes)]


def _checked(tokenised: DataFrame, hosts: DataFrame, find: Callable, mend: Callable) -> DataFrame:
    """``hosts`` with templates mended by what ``find`` finds against them on any page."""
    kinds = [pa.string(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for host, _, numbers, rounds, template in _rows(batch):
                found.update((host, *pair) for pair in find(roles_of(numbers, rounds), read_round(template)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], ["host", "a", "b"])

    told = tokenised.select("host", "row", "tokens").join(hosts.select("host", "rounds", "template"), "host")
    pairs = settle(told.mapInArrow(run, "host string, a int, b int").distinct(), "found")
    if pairs.isEmpty():
        return hosts
    found = pairs.groupBy("host").agg(F.collect_list(F.struct("a", "b")).alias("found"))
    columns = hosts.columns
    at = columns.index("template")

    def mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, at):
            pairs = some.column(len(columns)).to_pylist()
            new = [json.dumps(mend(json.loads(t), p or [])) for t, p in zip(some.column(at).to_pylist(), pairs)]
            kept = [pa.array(new, pa.string()) if i == at else some.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(kept, columns)

    return settle(hosts.join(found, "host", "left").select(*columns, "found").mapInArrow(mended, hosts.schema), "mended")


def _held(tokenised: DataFrame, found: DataFrame) -> DataFrame:
    """Per host the length of the texts that aren't the template's in the slots of each role that opens a main element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: Counter[tuple[str, int]] = Counter()
            lengths = batch.column(3)
            sizes = lengths.flatten().to_numpy(zero_copy_only=False)
            at = 0
            for host, _, numbers, rounds, template in _rows(batch.remove_column(3)):
                told = read_round(template)
                inside: list[int] = []
                for role, size in zip(roles_of(numbers, rounds), sizes[at : at + len(numbers)].tolist()):
                    if role in told.ends:
                        inside.append(role)
                    elif inside and role == told.ends[inside[-1]]:
                        inside.pop()
                    elif size and role not in told.places:
                        sums.update({(host, r): size for r in inside})
                at += len(numbers)
            if sums:
                rows = [(*key, size) for key, size in sums.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["host", "role", "chars"])

    told = tokenised.select("host", "row", "tokens", "lengths").join(found.select("host", "rounds", "template"), "host")
    sums = told.mapInArrow(run, "host string, role bigint, chars bigint").groupBy("host", "role").agg(F.sum("chars").alias("chars"))
    return sums.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("role", "chars"))).alias("held"))

def templates(pages: DataFrame) -> DataFrame:
    """Per host its number of pages and its template: classes of roles, the most frequent first, as JSON.

    ``pages`` has ``page_id``, ``host`` and ``html``; pages without a token don't count. A
    class holds its roles and the marks of their tags (``=`` for texts) in the order of the
    page; those with ``nested`` are in the same order on all pages and nested in each other
    at fixed places. ``rounds`` are the earlier templates, by which ``roles_of`` tells roles
    apart; ``held`` says how much text of slots the roles that open main elements hold. Only roles of at least half of a host's pages are in a class, so a template is at
    most twice as large as a page. Each round splits roles of the last, and only hosts where
    it does go on, so rounds end.
    """
    tokenised = settle(_tokenised(pages), "tokens")
    marks = tokenised.select("host", F.explode("tags").alias("t")).groupBy("host", F.col("t.token").alias("token")).agg(F.first("t.mark").alias("mark"), F.first("t.main").alias("main"))
    marks = settle(marks, "marks")
    sizes = tokenised.where(F.size("tokens") > 0).groupBy("host").agg(F.count("*").alias("host_pages"))
    hosts = settle(sizes.select("host", "host_pages", F.array().cast("array<string>").alias("rounds"), F.lit(0).cast("long").alias("n_roles")), "hosts")
    ended: list[DataFrame] = []
    while True:
        counted = settle(_role_counts(tokenised, hosts), "roles")
        roles = hosts.join(counted.groupBy("host").agg(F.count("*").alias("n_found")), "host")
        same = F.col("n_found") == F.col("n_roles")
        if "template" in hosts.columns:
            ended.append(roles.where(same).select("host", "host_pages", F.expr("slice(rounds, 1, size(rounds) - 1)").alias("rounds"), F.element_at("rounds", -1).alias("template")))
        split = settle(roles.where(~same).select("host", "host_pages", "rounds"), "split")
        if split.isEmpty():
            break
        candidates = settle(split.join(_classes(counted, marks), "host"), "classes")
        valid = _checked(tokenised, candidates, _disorders, partial(ordered, together=True))
        if valid is not candidates:
            valid = _checked(tokenised, valid, _disorders, ordered)
        valid = _checked(tokenised, valid, _straddles, nested)
        hosts = valid.withColumn("rounds", F.concat("rounds", F.array("template")))
    if not ended:  # no page has a token
        return hosts.select("host", "host_pages", "rounds", F.lit("[]").alias("template"), F.lit(None).cast("map<bigint,bigint>").alias("held"))
    found = settle(reduce(DataFrame.unionByName, ended), "templates")
    return found.join(_held(tokenised, found), "host", "left")


@lru_cache(maxsize=256)
def read_template(told: str | None, host_pages: int | None) -> tuple[str, frozenset[int]]:
    """The element that holds the article, if the template has one, and the template's own texts."""
    classes = json.loads(told) if told else []
    names = [m.rsplit("/", 1)[-1].split(".")[0] for c in classes for m in c["marks"] if m[0] == "<" and f">{m[1:]}" in c["marks"]]
    main = next((name for name in MAIN if name in names), "")
    if not host_pages or host_pages < CONSTANT_PAGES:
        return main, frozenset()
    whole = [c for c in classes if c["pages"] == host_pages and (c["nested"] or c["times"] == host_pages)]
    return main, frozenset(r for c in whole for r, m in zip(c["roles"], c["marks"]) if m == "=")


def article_roles(told: str | None, held: dict[int, int], main: str) -> tuple[frozenset[int], frozenset[int]]:
    """Roles of the tags that open the article's slots, and of those that open lists, as of teasers or comments.

    The role whose slots hold most text on the host is the article's. If it is there once a
    page, roles that come several times on a page are lists.
    """
    if not told or not main or not held:
        return frozenset(), frozenset()
    return _article_roles(told, tuple(sorted(held.items())), main)


@lru_cache(maxsize=256)
def _article_roles(told: str, held: tuple[tuple[int, int], ...], main: str) -> tuple[frozenset[int], frozenset[int]]:
    chars = dict(held)
    known = {r: c["times"] == c["pages"] for c in json.loads(told) if c["nested"] for r, m in zip(c["roles"], c["mains"]) if m == main}
    most = max((chars.get(r, 0) for r in known), default=0)
    article = frozenset(r for r in known if most and chars.get(r, 0) == most)
    once = all(known[r] for r in article)
    return article, frozenset(r for r in known if once and r not in article and not known[r])


def _articles(found: list[tuple[Element, ...]]) -> set[Element]:
    """The article elements among those that are given with all elements around them.

    What is around all of them isn't boilerplate, whatever its name or class says; an
    article inside another marked element is one only if all are.
    """
    marked = [{e for e in stack[:-1] if e.other or e.outside} for stack in found]
    shared = set.intersection(*marked) if marked else set()
    plain = {stack[-1] for stack, own in zip(found, marked) if own <= shared}
    return plain or {stack[-1] for stack in found}


def main_text(page: str, main: str, constant: frozenset[int], rounds: Sequence[str] = (), opening: frozenset[int] = frozenset(), lists: frozenset[int] = frozenset()) -> str:
    """Blocks of the article's slots; without an article, those of the page that the template doesn't hold.

    The slots are those between tokens of the roles ``opening`` and their ends, and what other
    elements named ``main`` hold that aren't ``lists`` of the template. On pages without that
    role it is all elements of that name, or else of another article's. The sets hold roles
    after ``rounds``.
    """
    parsed: list[tuple[str, str, tuple[Element, ...]]] = []
    names: set[str] = set()
    for kind, text, stack in tokens(page):
        parsed.append((kind, text, tuple(stack)))
        if kind == "<" and stack[-1].main:
            names.add(stack[-1].main)
    region = main if main in names else next((m for m in MAIN if m in names), "")
    numbers: dict[int, int | None] = {}
    if rounds:
        told = [(i, n) for i, token in enumerate(parsed) if (n := _number(*token)) is not None]
        numbers = dict(zip((i for i, _ in told), roles_of([n for _, n in told], rounds)))

    def role(i: int) -> int | None:
        return numbers.get(i) if rounds else _number(*parsed[i])

    articles: set[Element] = set()
    if region:
        found = [i for i, (kind, _, stack) in enumerate(parsed) if kind == "<" and stack[-1].main == region and not any(e.main == region for e in stack[:-1])]
        roles = [role(i) for i in found]
        if not opening.isdisjoint(roles):
            found = [i for i, r in zip(found, roles) if r not in lists]
        articles = _articles([parsed[i][2] for i in found])
    blocks: list[str] = []
    held: list[str] = []

    def end() -> None:
        if text := _tidy_parts(held):
            blocks.append(text)
        held.clear()

    for i, (kind, text, stack) in enumerate(parsed):
        start = next((d for d, e in enumerate(stack) if e in articles), None) if region else 0
        if start is None or any(e.other for e in stack[start:]) or not region and any(e.outside for e in stack):
            end()
        elif kind:
            if stack[-1].name not in INLINE:
                end()
            elif stack[-1].name == "br":
                held.append(" ")
        elif region or not constant or role(i) not in constant:
            held.append(text)
    end()
    return "\n".join(blocks)


def _tidy_parts(parts: list[str]) -> str:
    return " ".join("".join(html.unescape(p) for p in parts).split())


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``pages`` with ``text``: the article's blocks, one a line.

    Character references are decoded and white space inside a block is one space. A null or
    empty page gives an empty text; a page without an article gives what stands outside
    menus, forms and the like and is not constant on the host. Pages without a host share
    one template; rows of one page count as often as they stand there. An existing ``text``
    is replaced. Templates are joined to pages by host: one row a host, however many pages.
    """
    names = [c for c in pages.columns if c not in ("text", "host_pages", "template", "rounds", "held", "_host")]
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    hosted = pages.select(*names, host.alias("_host"))
    known = settle_alone(lambda: templates(hosted.select(F.col(key).alias("page_id"), F.col("_host").alias("host"), F.col(page).alias("html"))), "templates")
    joined = hosted.join(known.withColumnRenamed("host", "_host"), "_host", "left").select(*names, "host_pages", "template", "rounds", "held")
    schema = T.StructType([*pages.select(*names).schema.fields]).add("text", "string")
    at = names.index(page)

    def text(value: str, host_pages: int | None, template: str | None, rounds: list[str] | None, held: list[tuple[int, int]] | None) -> str:
        main, constant = read_template(template, host_pages)
        return main_text(value, main, constant, rounds or (), *article_roles(template, dict(held or ()), main))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, at):
            told = zip(*(some.column(i).to_pylist() for i in (at, *range(len(names), len(names) + 4))))
            texts = [text(value or "", *more) for value, *more in told]
            yield pa.RecordBatch.from_arrays([*some.columns[: len(names)], pa.array(texts, pa.string())], [*names, "text"])

    return joined.mapInArrow(run, schema)
