"""Main text of web pages by deducing each host's template from equivalence classes of tokens (after Arasu and Garcia-Molina, SIGMOD 2003).

Tokens of a page are its structural elements, told apart by their path of block elements with class and id, and its blocks of text, told
apart by path and words. Pass 1 counts them: tokens of a host with the same occurrence vector (the count on each page) form an
equivalence class. Vectors are compared through sums of hashes of (page, count), combined before the shuffle, so that
nothing is gathered per host but its distinct tokens with enough pages, and pages that repeat do not cancel out. A class counts if it is found
on SUPPORT pages at least. Pass 2 checks the order: tokens of a class that a page has out of the class's order are struck out where this happens
on more than a tenth of the class's pages; what is left is valid. Nesting holds by the paths: a class lies in the slot of the nearest
valid path above it, and the slots of this tree are measured (characters, characters of links). Pass 3 takes out the slots that say the
same on every page (whose blocks are tokens of the class found on all pages), and extracts the remaining ones: within the content element where the page has one, else all slots of the
template that are neither chrome (by the elements and names on the template's own path) nor mostly links.

On a host of fewer than SUPPORT pages, or one whose pages have all the same texts, no block of text is template, and the page's own
elements stand for the template's. Menus, headers, footers, sidebars, notices, adverts, forms and reader comments within the content
element go by element or by a whole class name, so that class="share-price" or "post-header" is text.

Defined results: null, empty or text-free html gives an empty text and does not count as a page of its host; pages without a url are a host of
their own; rows that repeat give a row each; long tokens, blocks and pages are taken whole; ties between places keep the
order of the tokens' hashes; an empty table gives an empty one; other columns, whatever their names, are dropped.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import table
from braidwork.shared import written

#: Pages that a class needs.
SUPPORT = 3
#: Templates are broadcast up to so many tokens (48 bytes each), beyond that joined by host, each host dealt out to SALTS parts.
BROADCAST_TOKENS, SALTS = 200_000, 16
# Elements that hold no text, elements and names that mark what is not the article, elements that end a block, elements without content.
NOT_TEXT = frozenset("head script style noscript template svg math iframe object canvas select textarea button title".split())
CHROME = frozenset("nav header footer aside form dialog menu".split())
INNER_CHROME, OUTER_CHROME = CHROME - {"header"}, CHROME - {"header", "form"}
CONTENT = frozenset("article main".split())
CHROME_WORDS = frozenset("ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent notice alert newsletter subscribe share social related sidebar breadcrumb breadcrumbs comment comments disqus menu nav navbar navigation footer header masthead popup modal widget".split())
INNER_WORDS = CHROME_WORDS - {"header"}
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "template"))
#: An open <p> ends where one of these begins.
ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "caption", "body", "html", "title", "legend"}
#: An open element ends where the like of it begins, up to the element that holds them.
SIBLINGS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}


def parse(html: str):
    """Yields (kind, name, names) for tags, kind 1 opening and -1 closing, names being class, id and role, and (0, text, ""); comments and raw elements are skipped."""
    import re

    tag = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
    named = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
    at, n = 0, len(html)
    while at < n:
        m = tag.search(html, at)
        if m is None:
            yield 0, html[at:], ""
            return
        if m.start() > at:
            yield 0, html[at : m.start()], ""
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            yield -1, name, ""
            continue
        words = ""
        if "=" in m[3]:
            words = " ".join(" ".join(v.strip("\"'").lower() for _, v in sorted((k.lower(), v) for k, v in named.findall(m[3]))).split())
        yield 1, name, words
        if name in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            yield -1, name, ""


def page_tokens(html: str):
    """(elements, blocks) of a page, in page order.

    elements: (place, path number) of every block element; blocks: (place, path, text, characters in links), path being the tuple of
    (path number, name, names) from the outermost element. A path number is a hash of the names on the path. What is in NOT_TEXT is left out.
    """
    import re
    from html import unescape

    import xxhash

    stack: list[tuple[int, str, str]] = []
    text: list[str] = []
    elements, blocks = [], []
    place = linked = in_link = silent = 0
    space = re.compile(r"\s+")

    def flush():
        nonlocal linked, place
        if text:
            said = space.sub(" ", unescape("".join(text))).strip()
            text.clear()
            if said:
                blocks.append((place, tuple(stack), said, min(linked, len(said))))
                place += 1
        linked = 0

    for kind, name, names in parse(html):
        if kind == 0:
            if not silent:
                text.append(name)
                if in_link:
                    linked += len(name)
            continue
        if name in VOID:
            if name == "br":
                text.append(" ")
            elif name == "hr":
                flush()
            continue
        block, mute = name in BLOCKS, name in NOT_TEXT
        if kind > 0:
            if name == "a":
                in_link = 1
            if not block and not mute and CHROME_WORDS.isdisjoint(names.split()):
                continue
            if block or not mute:
                flush()
            if block and name != "title":
                _close(stack, ("head",), ("body",))
            if name in ENDS_P:
                _close(stack, ("p",), BLOCKS - {"p"})
            if name in SIBLINGS:
                like, holder = SIBLINGS[name]
                _close(stack, like.split(), holder.split())
            above = stack[-1][0] if stack else 0
            # Paragraphs share the path of what holds them: how many there are, and how they are marked up, is the article's own.
            if name == "p" and not names:
                stack.append((above, name, names))
            else:
                number = xxhash.xxh64_intdigest(f"{name} {names}", above) >> 1
                stack.append((number, name, names))
                if not mute:
                    elements.append((place, number))
                    place += 1
        else:
            if name == "a":
                in_link = 0
            if block:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][1] == name:
                    if not block and not mute:
                        flush()
                    del stack[i:]
                    break
                if not block and not mute and stack[i][1] in BLOCKS:  # an inline element's end closes no block
                    break
        silent = any(x[1] in NOT_TEXT for x in stack)
    flush()
    return elements, blocks


def _close(stack, names, holders) -> None:
    """Ends the nearest open element of names, if it is not outside of a holder."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][1] in names:
            del stack[i:]
            return
        if stack[i][1] in holders:
            return


def _text_token(path, said: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(said, path[-1][0] if path else 0) >> 1


def events(elements, blocks):
    """(place, token, whether it is text) in page order."""
    seen = [(place, number, False) for place, number in elements]
    return sorted(seen + [(place, _text_token(path, said), True) for place, path, said, _ in blocks])


_TOKENS = {"host": pa.string(), "token": pa.int64(), "is_text": pa.bool_(), "n": pa.int64(), "a": pa.int64(), "b": pa.int64(), "place": pa.float64()}


def _batch(rows, types):
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))


def _count(batches):
    """A row per page and distinct token; token 0 stands for the page itself. a and b are two halves of a hash of (page, count)."""
    from collections import Counter

    import xxhash

    for batch in batches:
        rows = []
        for host, page, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = events(*page_tokens(html or ""))
            if not any(is_text for _, _, is_text in found):
                continue
            own = xxhash.xxh64_intdigest(f"{page} {len(html)}", xxhash.xxh64_intdigest(html))
            times = Counter((token, is_text) for _, token, is_text in found)
            first = {}
            for i, (_, token, _) in enumerate(found):
                first.setdefault(token, i / len(found))
            for (token, is_text), n in [((0, False), 1), *times.items()]:
                h = xxhash.xxh64_intdigest(n.to_bytes(8, "little"), own)
                rows.append((host, token, is_text, n, h & 0x7FFFFFFF, h >> 32 & 0x7FFFFFFF, first.get(token, 0.0)))
        yield _batch(rows, _TOKENS)


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): array<struct<class, at, token, is_text>> of the classes with enough pages; at is the token's place within its class.

    pages has host, page, html. Of texts only those on all pages of the host are kept.
    """
    tokens = pages.select("host", "page", "html").mapInArrow(_count, "host string, token long, is_text boolean, n long, a long, b long, place double")
    per = tokens.groupBy("host", "token", "is_text").agg(F.count("*").alias("pages"), F.sum("n").alias("times"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.avg("place").alias("place"))
    per = written(per.where((F.col("pages") >= SUPPORT) | (F.col("token") == 0)), "host-tokens")
    whole = per.where("token = 0").select("host", F.col("pages").alias("all"))
    known = per.where("token <> 0").join(whole, "host").where(~F.col("is_text") | (F.col("pages") == F.col("all")))
    classes = known.groupBy("host", "a", "b", "pages", "times").agg(F.array_sort(F.collect_list(F.struct("place", "token", "is_text"))).alias("members"))
    name = F.xxhash64("a", "b", "pages", "times")
    flat = F.transform("members", lambda x, i: F.struct(name.alias("class"), i.alias("at"), x["token"].alias("token"), x["is_text"].alias("is_text")))
    return classes.groupBy("host").agg(F.flatten(F.collect_list(flat)).alias("template"))


def disordered(found, template) -> set[int]:
    """Tokens that a page has out of their class's order: within a class, what is outside a longest ordered chain of each round through it."""
    from bisect import bisect_left

    place = {x["token"]: (x["class"], x["at"]) for x in template}
    per: dict[int, list[tuple[int, int]]] = {}
    for _, token, _ in found:
        if token in place:
            c, at = place[token]
            per.setdefault(c, []).append((at, token))
    bad = set()
    for seen in per.values():
        rounds: dict[int, int] = {}
        # The k-th occurrences of all members form the k-th round; rounds follow each other and are ordered in themselves.
        keys = []
        for at, token in seen:
            k = rounds.get(token, 0)
            rounds[token] = k + 1
            keys.append((k, at))
        tails, ends, before = [], [], []
        for i, key in enumerate(keys):
            j = bisect_left(tails, key)
            before.append(ends[j - 1] if j else -1)
            if j == len(tails):
                tails.append(key)
                ends.append(i)
            else:
                tails[j] = key
                ends[j] = i
        keep, i = set(), ends[-1] if ends else -1
        while i >= 0:
            keep.add(i)
            i = before[i]
        bad |= {seen[i][1] for i in range(len(seen)) if i not in keep}
    return bad


_CHECKED = {"host": pa.string(), "kind": pa.int32(), "token": pa.int64(), "n": pa.int64(), "m": pa.int64()}


def _known(host, column, i, held: dict):
    """The template of row i, read once per host and worker (the worker's table of hosts is emptied when it has grown)."""
    if host not in held:
        if len(held) > 2_000:
            held.clear()
        held[host] = column[i].as_py() or ()
    return held[host]


def _check(batches):
    """kind 0: (token, pages that have it out of order, pages); kind 1: (slot, characters, characters of links); kind 2: (0, pages with main text besides the template, 0)."""
    held: dict = {}
    for batch in batches:
        rows = []
        for i, (host, html) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            template = _known(host, batch.column(1), i, held)
            if not template or not html:
                continue
            elements, blocks = page_tokens(html)
            found = events(elements, blocks)
            known = {x["token"] for x in template}
            bad = disordered(found, template)
            rows += [(host, 0, token, int(token in bad), 1) for token in {t for _, t, _ in found} & known]
            slots: dict[int, list[int]] = {}
            for _, path, said, linked in blocks:
                if _text_token(path, said) not in known:
                    own = slots.setdefault(slot_of(path, known), [0, 0])
                    own[0] += len(said)
                    own[1] += linked
            rows += [(host, 1, slot, n, m) for slot, (n, m) in slots.items()]
            rows.append((host, 2, 0, int(bool(main_text(blocks, [x | {"valid": True} for x in template]))), 0))
        yield _batch(rows, _CHECKED)


def slot_of(path, known) -> int:
    """The nearest path of the template above a block; 0 where there is none."""
    return next((x[0] for x in reversed(path) if x[0] in known), 0)


def _chrome(path, known) -> bool:
    """Whether a block outside of content elements is in what is not the article. known: the template's tokens, or None for the page's own elements."""
    import re

    for number, name, names in path:
        if name in NOT_TEXT or name in CHROME or not CHROME_WORDS.isdisjoint(names.split()):
            return True
        # Parts of a name count where the template has the element.
        if names and (known is None or number in known) and not CHROME_WORDS.isdisjoint(re.findall(r"[a-z]+", names)):
            return True
    return False


def _inner_chrome(path, at: int) -> bool:
    """Whether a block in the content element path[at] is no part of the article, or this element stands in a sidebar or the like."""
    if any(x[1] in OUTER_CHROME for x in path[:at]):
        return True
    return any(name in NOT_TEXT or name in INNER_CHROME or not INNER_WORDS.isdisjoint(names.split()) for _, name, names in path[at + 1 :])


def main_text(blocks, template=(), menus=(), varying=()) -> str:
    """The text of one page. template: the tokens of its host; menus: slots that are mostly links; varying: slots with texts of their own on some page."""
    slots = {x["token"] for x in template if not x["is_text"]} if template else None
    known = {x["token"] for x in template if not x["is_text"] and x["valid"]} if template else None
    fixed = {x["token"] for x in template if x["is_text"] and x["valid"]}
    inside, outside = [], []
    has_content = False
    for _, path, said, _ in blocks:
        at = next((i for i, x in enumerate(path) if x[1] in CONTENT or x[2] == "main"), None)
        # A slot that says the same on every page is no page's own text.
        own = not fixed or _text_token(path, said) not in fixed or slot_of(path, slots) in varying
        if at is not None:
            has_content = True
            if own and not _inner_chrome(path, at):
                inside.append(said)
        elif not has_content and own and not _chrome(path, known) and (slots is None or slot_of(path, slots) not in menus):
            outside.append(said)
    return "\n\n".join(inside if has_content else outside)


def _extract(batches):
    held: dict = {}
    for batch in batches:
        out = []
        more = [batch.column(k) for k in (5, 6)]
        for i, (html, host) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            out.append(main_text(page_tokens(html or "")[1], _known(host, batch.column(4), i, held), *(set(c[i].as_py() or ()) for c in more)))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def valid(found: DataFrame, checked: DataFrame) -> DataFrame:
    """(host, template, menus, varying): the templates' tokens with valid, false for those out of order on more than a tenth of their pages, and for texts where the host has no other."""
    some = lambda said, name: checked.where(said).groupBy("host").agg(F.collect_set("token").alias(name))
    varies = checked.where("kind = 2").select("host", (F.col("n") > 0).alias("varies"))
    every = found.join(some("kind = 0 AND 10 * n > m", "bad"), "host", "left").join(varies, "host", "left")
    every = every.join(some("kind = 1 AND 2 * m > n", "menus"), "host", "left").join(some("kind = 1", "varying"), "host", "left")
    good = lambda x: ~F.array_contains(F.coalesce("bad", F.array().cast("array<long>")), x["token"]) & (~x["is_text"] | F.coalesce("varies", F.lit(False)))
    return every.select("host", F.transform("template", lambda x: F.struct(x["token"].alias("token"), x["is_text"].alias("is_text"), good(x).alias("valid"))).alias("template"), "menus", "varying")


def extract(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", deduce: bool = True) -> DataFrame:
    """(page_id, url, text) of every row. Without deduce no template is used."""
    kind = pages.schema[page].dataType.simpleString()
    p = pages.select(F.col(page).alias("page"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    if not deduce:
        none = F.lit(None)
        ready = p.select(F.col("page").alias("page_id"), "url", "html", "host", none.cast("array<struct<token:long,is_text:boolean,valid:boolean>>").alias("template"), none.cast("array<long>").alias("menus"), none.cast("array<long>").alias("varying"))
        return ready.mapInArrow(_extract, f"page_id {kind}, url string, text string")
    found = written(templates(p), "host-templates")
    checked = _with(p, found).select("host", "template", "html").mapInArrow(_check, "host string, kind int, token long, n long, m long")
    checked = written(checked.groupBy("host", "kind", "token").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "host-slots")
    good = written(valid(found, checked), "host-valid")
    ready = _with(p, good).select(F.col("page").alias("page_id"), "url", "html", "host", "template", "menus", "varying")
    return ready.mapInArrow(_extract, f"page_id {kind}, url string, text string")


def _with(pages: DataFrame, found: DataFrame) -> DataFrame:
    """pages with the columns of found, a row per host. Above the bound both sides are shuffled, hosts in SALTS parts so that a hot one is spread."""
    n = found.agg(F.sum(F.size("template"))).first()[0] or 0
    if n <= BROADCAST_TOKENS:
        return pages.join(F.broadcast(found), "host", "left")
    salted = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = pages.withColumn("_salt", F.pmod(F.xxhash64("page", "url"), F.lit(SALTS)).cast("int"))
    return own.join(salted, ["host", "_salt"], "left").drop("_salt")


def op10_template_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
