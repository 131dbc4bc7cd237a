"""Main text of web pages by equivalence-class template deduction.

1. Every page becomes a sequence of tokens: container tags and text blocks, each
   told apart by the path of containers around it.
2. The occurrence vector of a token says how often it occurs on every page of its
   host. Spark keeps it as a sum of hashes over (page, count), which is the same
   number for equal vectors and needs one partial aggregation, whatever the size
   of the host. Tokens under ``article`` or ``main`` count once per distinct
   article content instead of once per page, so that pages which repeat an article
   do not turn it into a template.
3. Tokens of a host with one vector form an equivalence class. Classes that are
   large (two tokens or more) and frequent (on at least three pages and half of
   the host's; under ``article`` and ``main``, contents instead of pages) are its
   template. On a page a class is valid if its tokens stand in the class's order
   there, once or several times over; classes nest by their containers.
4. What lies between template tokens are the slots. The article's slot is the one
   under ``article`` or ``main``; on pages without, the container with most text
   outside the template over all pages of the host, or of the page where it is the
   host's only one. Slots under navigation, notices and other page furniture are
   no part of it, nor are the template's own words, wherever they stand.

Tokens travel as 64-bit hashes of path and text; only paths are kept as text.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaymill.llm.common import bounded_batches, text_of, without, written

OUTPUT = ("text", "n_chars")

# Elements and name parts that mark page furniture.
FURNITURE = frozenset("nav header footer aside form menu dialog noscript iframe object svg canvas button select textarea template head".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer "
    "header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related respond share sharing "
    "sidebar social sponsor sponsored subscribe toolbar widget".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = frozenset("html head body article main section div nav header footer aside form menu dialog noscript object svg canvas button select template table ul ol dl figure fieldset details span p".split())
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

Token = tuple[str, str, bool, bool]  # path, text ("" for a tag), under furniture, under article or main


def _furniture(name: str, attrs: str) -> tuple[bool, str]:
    """Whether an element is page furniture, and how its path names it."""
    if name in FURNITURE:
        return True, name
    junk, label = False, name
    for key, *values in _NAMED.findall(attrs) if attrs.strip() else ():
        value = next((v for v in values if v), "").lower()
        if key.lower() == "role":
            junk |= value.strip() in FURNITURE_ROLES
        else:
            words = [w for w in re.split(r"[^a-z]+", value) if w]
            # The page's own frame may carry any class; only its parts are furniture.
            junk |= name not in ("html", "body", "article", "main") and not FURNITURE_WORDS.isdisjoint(words)
            label += "." + "-".join(words)
    return junk, label


def tokens(page: str) -> list[Token]:
    """Container tags and text blocks of a page, in order."""
    out: list[Token] = []
    stack: list[tuple[str, str, bool, bool]] = []  # name, path, furniture, main
    parts: list[str] = []
    # Only A-Z, one for one: other letters change their length, and with it all places after them.
    lowered = page.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            _, path, junk, main = stack[-1] if stack else ("", "", False, False)
            out.append((path, text, junk, main))

    at = 0
    while at < len(page):
        found = _MARKUP.search(page, at)
        if not found:
            parts.append(page[at:])
            break
        parts.append(page[at : found.start()])
        at = found.end()
        if found["cdata"] is not None:
            parts.append(found["cdata"])
        if found["name"] is None:
            continue
        name = found["name"].lower()
        if name in BLOCKS:
            flush()
        elif name == "br":
            parts.append(" ")
        if found["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name not in BLOCKS and stack[k][2]:
                        flush()
                    del stack[k:]
                    break
            continue
        if name in RAW:  # nothing inside is markup, and none of it is text
            end = re.compile(rf"</{re.escape(name)}\s*>").search(lowered, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID or found["attrs"].rstrip().endswith("/") or name not in CONTAINERS:
            continue
        junk, label = _furniture(name, found["attrs"])
        # Phrasing elements only matter as furniture; one that never ends holds nothing.
        if (name in ("p", "span") and not junk) or lowered.find(f"</{name}", at) < 0 and name not in ("html", "body", "article", "main"):
            continue
        if junk and name not in BLOCKS:
            flush()
        if name == "p":
            stack[:] = [s for s in stack if s[0] != "p"]
        _, path, inside, main = stack[-1] if stack else ("", "", False, False)
        path = f"{path}/{label}"
        stack.append((name, path, inside or junk, main or name in ("article", "main")))
        out.append((path, "", inside or junk, stack[-1][3]))
    flush()
    return out


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map (_host, _page, _html) to (host, page, path, token, length, n, place, junk, main) per distinct token of the page.

    Under ``article`` and ``main``, ``page`` is the hash of the article's content.
    """
    for batch in batches:
        for host, page, text in zip(*(batch.column(c).to_pylist() for c in ("_host", "_page", "_html"))):
            read = tokens(text)
            content = _hash(*(block for _, block, junk, main in read if block and main and not junk))
            seen: dict[tuple[str, str], list] = {}
            for place, (path, block, junk, main) in enumerate(read):
                seen.setdefault((path, block), [0, place, junk, main])[0] += 1
            rows = [(content if v[3] else page, path, _hash(path, block), len(block), *v) for (path, block), v in seen.items()]
            if rows:
                pages, path, token, length, n, place, junk, main = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([host] * len(rows)), pa.array(pages, pa.int64()), pa.array(path), pa.array(token, pa.int64()), pa.array(length, pa.int32()),
                        pa.array(n, pa.int32()), pa.array(place, pa.int32()), pa.array(junk), pa.array(main),
                    ],
                    names=["host", "page", "path", "token", "length", "n", "place", "junk", "main"],
                )


def deduce_templates(pages: DataFrame) -> DataFrame:
    """(host, template, slot) per host from ``pages`` (_host, _page, _html).

    ``template``: (token, class, order) of its tokens. ``slot``: the path of the
    container that holds most text outside the template, ``article`` and ``main`` apart.
    """
    kind = "host string, page bigint, path string, token bigint, length int, n int, place int, junk boolean, main boolean"
    rows = written(pages.mapInArrow(_token_rows, kind))
    inside = rows.where("main").groupBy("host", "page", "path", "token", "length", "junk", "main").agg(F.min("n").alias("n"), F.min("place").alias("place"))
    counted = rows.where("NOT main").unionByName(inside)
    contents = rows.where("main").groupBy("host").agg(F.count_distinct("page").alias("pages")).withColumn("main", F.lit(True))
    size = pages.groupBy(F.col("_host").alias("host")).agg(F.count("*").alias("pages")).withColumn("main", F.lit(False)).unionByName(contents)
    # Halves of the hashes, so that sums cannot overflow.
    half = [F.sum(F.xxhash64("page", "n", F.lit(k)).bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"v{k}") for k in (0, 1)]
    vectors = counted.groupBy("host", "main", "path", "token").agg(
        F.count("*").alias("support"), F.avg("place").alias("at"), F.first("length").alias("length"), F.first("junk").alias("junk"), *half
    )
    vectors = written(vectors.join(size, ["host", "main"]))
    frequent = vectors.where("support >= 3 AND 2 * support >= pages")
    classes = frequent.groupBy("host", "main", "v0", "v1", "support").agg(F.count("*").alias("size"), F.sort_array(F.collect_list(F.struct("at", "path", "token"))).alias("members"))
    large = classes.where("size >= 2").withColumn("class", F.xxhash64("main", "v0", "v1"))
    member = large.select("host", "class", F.posexplode("members").alias("order", "m")).select("host", "class", "order", "m.token")
    template = member.groupBy("host").agg(F.collect_list(F.struct("token", "class", "order")).alias("template"))
    data = vectors.where("length > 0 AND NOT junk AND NOT main").join(member.select("host", "token"), ["host", "token"], "left_anti")
    volume = data.groupBy("host", "path").agg(F.sum(F.col("length") * F.col("support")).alias("volume"))
    slot = volume.groupBy("host").agg(F.max_by("path", F.struct("volume", "path")).alias("slot"))
    return template.join(slot, "host", "full")


def extract_page(page: str, template: dict[int, tuple[int, int]], slot: str | None) -> str:
    """The article's text: its blocks in page order, parted by blank lines."""
    read = tokens(page)
    places = [template.get(_hash(path, block)) if template else None for path, block, _, _ in read]
    # A class whose tokens are out of order here is not valid on this page; each round begins with its first token.
    last: dict[int, int] = {}
    broken: set[int] = set()
    for place in places:
        if place is not None:
            if 0 < place[1] < last.get(place[0], -1):
                broken.add(place[0])
            last[place[0]] = place[1]

    free = [(path, block, main) for (path, block, junk, main), place in zip(read, places) if block and not junk and (place is None or place[0] in broken)]
    if any(main for *_, main in read):
        return "\n\n".join(block for _, block, main in free if main)
    data = [(path, block) for path, block, _ in free]
    if slot is not None and any(path == slot for path, _ in data):
        data = [(path, block) for path, block in data if path == slot or path.startswith(slot + "/")]
    elif data:
        volume: dict[str, int] = {}
        for path, block in data:
            volume[path] = volume.get(path, 0) + len(block)
        top = max(sorted(volume), key=volume.__getitem__)
        data = [(path, block) for path, block in data if path == top or path.startswith(top + "/")]
    return "\n\n".join(block for _, block in data)


def _extracted(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            texts = []
            templates = batch.column("template")
            for k, (host, page, slot) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_host", "_html", "slot")))):
                if host not in known:
                    if len(known) > 64:
                        known.clear()
                    known[host] = {t["token"]: (t["class"], t["order"]) for t in templates[k].as_py() or ()}
                texts.append(extract_page(page, known[host], slot))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, *OUTPUT])

    return run


def extract_main(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Replace the html of every page by its main text: all other columns, ``text`` and ``n_chars``.

    Character references are decoded, white space inside a block becomes one
    space, blocks follow page order with an empty line between them. A null or
    empty html, and a page without an article, gives an empty text. Pages with a
    null url, or one without a host, share one nameless host. Rows that repeat a
    page count as pages of their own. Input columns named like a result are
    replaced. ``n_chars`` counts code points.
    """
    bounded_batches(pages.sparkSession)
    rows = without(pages, [*OUTPUT, "_host", "_page", "_html", "host", "template", "slot"])
    host = F.coalesce(F.regexp_extract(F.col(url_col), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit(""))
    rows = rows.withColumn("_host", F.lower(host)).withColumn("_html", text_of(html_col))
    # A page's number in its host's occurrence vectors; equal pages may share one.
    numbered = rows.select("_host", F.xxhash64(url_col, "_html").alias("_page"), "_html")
    templates = written(deduce_templates(numbered))
    joined = rows.join(templates, rows["_host"] == templates["host"], "left")
    names = [c for c in rows.columns if c not in ("_host", "_html", html_col)]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names]
    return joined.select(*names, "_host", "_html", "template", "slot").mapInArrow(_extracted(names), ", ".join([*fields, "text string, n_chars bigint"]))
