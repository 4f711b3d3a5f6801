"""Main content of page texts: boosted trees over the nodes of a page's tree, decoded from the top."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lexaria.llm.boosting import BoostedTrees, fit
from lexaria.session import stored

BULLET = re.compile(r"^\s*[•–›»·▪◦*-]\s+")
STOP = re.compile(r"[.!?…]['\"»”)]*\s*$")
MARKS = re.compile("[̀-ͯ]+")
SENTENCE = re.compile(r"[.!?…;]\s+")
SEPARATOR = re.compile(r"\s[»·|>•]\s|\s{2,}")
#: A label and a path below it.
PATH = re.compile(r"^[^:>]+:[^>]+>[^>]")
SPACES, NUMBER = re.compile(r"\s+"), re.compile(r"\d+")

KINDS = ("menu", "path", "template", "common", "prose", "phrase")
FURNITURE = frozenset(("menu", "path", "template"))
#: A line beside so many different texts is looked at for a template; from UNSURE on a line of sentences teaches neither.
MANY, UNSURE = 5, 3
#: Chance that another page of the same host has the line, too, from which on a line is the host's template, and from which on it is more than chance.
SHARED, COMMON = 0.5, 0.03
#: A common line with a larger share teaches neither.
DOUBTFUL = 0.3
#: Fewest words of a sentence that marks a text, and most words of a line without sentences.
LONG, SHORT = 4, 11


def line_key(line: str, host: str = "") -> str:
    """A line without accents, case, bullet and numbers, the page's host as @."""
    s = BULLET.sub("", line).strip().casefold()
    if not s.isascii():
        s = MARKS.sub("", unicodedata.normalize("NFKD", s))
    if host:
        s = s.replace(host, "@")
    return SPACES.sub(" ", NUMBER.sub("0", s))


def line_hash(key: str) -> int:
    h = xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >= 1 << 63 else h


def text_mark(keys: Iterable[str]) -> int:
    """The least hash of a page's sentences: copies of an article mostly share it, different articles of one site don't."""
    parts = [x for k in keys for x in SENTENCE.split(k) if x.count(" ") >= LONG - 1]
    return min(map(line_hash, parts or keys))


def menu_parts(line: str) -> list[str]:
    """The entries of a line that is a row of short entries and no sentence, else none."""
    if STOP.search(line):
        return []
    parts = [p for p in SEPARATOR.split(line.strip()) if p and not p.isspace()]
    return parts if len(parts) > 1 and all(len(p.split()) <= 3 for p in parts) else []


@dataclass(frozen=True, slots=True)
class Fact:
    """What the collection says of a line: different texts it stands beside, the chance that another page of a host with it has it, too (-1: no host has another page), and different texts beside menus with it as an entry."""

    spread: int = 1
    share: float = -1.0
    parts: int = 0


NO_FACT = Fact()


@dataclass(slots=True)
class Node:
    """A line of a page. ``parent`` is the line it hangs from (an item from its list's head, text from its heading), ``block`` its block."""

    at: int
    text: str
    key: str
    fact: Fact
    kind: str
    bullet: bool
    words: int
    times: int = 1  # lines of the page with this key
    parent: int = -1
    block: int = 0
    item: int = 0  # number within its list, 0 outside
    is_title: bool = False


@dataclass
class Page:
    nodes: list[Node]
    blocks: list[list[int]] = field(default_factory=list)


def _kind(line: str, key: str, words: int, fact: Fact) -> str:
    """From the line's form and the collection only; no word is looked at."""
    if PATH.match(key):
        return "path"
    if menu_parts(line):
        return "menu"
    sentences = words > SHORT or (STOP.search(line) is not None and words > 2) or (key.endswith((";", ":", ",")) and words > 4)
    if fact.spread >= MANY:
        if fact.share >= SHARED or (sentences and fact.share < 0):
            return "template"
        if not sentences and fact.share >= COMMON:
            return "common"
    return "prose" if sentences else "phrase"


def parse_page(text: str, host: str = "", facts: Mapping[int, Fact] | None = None) -> Page:
    """The tree of a page's lines: page, blocks, lines, and below a list's head its items, below a heading its text.

    Blocks are a list head with its items, a run of menu lines, a run of text with its headings, or a single line. A list is a short template line with the phrases
    after it that are all marked or all unmarked. A page whose text would have no title takes the last unmarked item of the list above the text for it.
    """
    host = host.removeprefix("www.")
    facts = facts or {}
    nodes: list[Node] = []
    times: dict[str, int] = {}
    for at, line in enumerate(text.split("\n")):
        if line.strip():
            key = line_key(line, host)
            times[key] = times.get(key, 0) + 1
            bullet = BULLET.match(line) is not None
            fact = facts.get(line_hash(key), NO_FACT) if facts else NO_FACT
            words = key.count(" ") + 1
            nodes.append(Node(at, line, key, fact, _kind(BULLET.sub("", line) if bullet else line, key, words, fact), bullet, words))
    crumb = None
    for n in nodes:
        n.times = times[n.key]
        if n.kind == "path":
            crumb = n.key.rsplit(">", 1)[-1].strip()
        elif crumb and n.key == crumb and n.kind not in FURNITURE:
            n.is_title, crumb = True, None
    page = Page(nodes)
    # lists
    head = -1
    mark = None
    for i, n in enumerate(nodes):
        if head >= 0 and n.kind == "phrase" and not n.is_title and mark in (None, n.bullet):
            mark = n.bullet
            n.parent, n.item = head, i - head
            continue
        head, mark = (i, None) if n.kind == "template" and n.words <= SHORT and not STOP.search(n.text) else (-1, None)
    body = next((i for i, n in enumerate(nodes) if n.kind == "prose" and n.fact.spread < MANY), len(nodes))
    if body < len(nodes) and not any(n.is_title or (n.kind == "phrase" and not n.item and not n.bullet) for n in nodes[:body]):
        last = next((i for i in range(body - 1, -1, -1) if nodes[i].kind != "common"), -1)
        if last >= 0 and nodes[last].item and not nodes[last].bullet:
            nodes[last].parent, nodes[last].item = -1, 0
    # blocks, and text below its heading
    group, heading = None, -1
    for i, n in enumerate(nodes):
        if n.item:
            side = "list"
        elif n.kind == "menu":
            side = "menu"
        elif n.kind in FURNITURE:
            side = f"line {i}"
        else:
            side = "body"
            if n.kind in ("common", "phrase"):
                heading = i
            elif heading >= 0:
                n.parent = heading
        new = not page.blocks or (side != group if side != "list" else n.item == 1 and nodes[n.parent].block != len(page.blocks) - 1)
        if new:
            page.blocks.append([])
        n.block = len(page.blocks) - 1
        page.blocks[-1].append(i)
        group = side
    return page


ENDS, DIGIT = re.compile(r"[.!?…](?:\s|$)"), re.compile(r"\d")
ONE_HOT = {c: [float(c == d) for d in KINDS] for c in KINDS}
NO_KIND = [0.0] * len(KINDS)
FEATURES = 42 + 3 * len(KINDS)


def tokens_of(key: str) -> list[str]:
    return key.split()


def features(page: Page, tokens: Mapping[str, float]) -> np.ndarray:
    """A row per line: its own text and tokens, its block (subtree density), depth, siblings, place, neighbours, and what the collection says of it and them. ``tokens`` has the learned log odds of words."""
    nodes = page.nodes
    n = len(nodes)
    out = np.zeros((n, FEATURES))
    text_lines = [i for i, x in enumerate(nodes) if x.kind == "prose"]
    first, last = (text_lines[0], text_lines[-1]) if text_lines else (n, -1)
    below = np.zeros(n)
    for x in nodes:
        if x.parent >= 0:
            below[x.parent] += len(x.text)
    of_block = []
    for members in page.blocks:
        block = [nodes[j] for j in members]
        m = len(block)
        of_block.append((math.log1p(sum(len(b.text) for b in block) / m), m, sum(b.words for b in block) / m, sum(b.bullet for b in block) / m, sum(b.fact.spread >= MANY for b in block) / m))
    furniture_before = 0
    for i, x in enumerate(nodes):
        density, m, mean_words, marked, known = of_block[x.block]
        prev, nxt = nodes[i - 1] if i else None, nodes[i + 1] if i + 1 < n else None
        own = [tokens.get(w, 0.0) for w in tokens_of(x.key)]
        size = len(x.text)
        depth = 2 + (x.parent >= 0) + (x.parent >= 0 and nodes[x.parent].parent >= 0) + x.bullet
        row = [
            math.log1p(size), x.words, STOP.search(x.text) is not None, len(ENDS.findall(x.text)), len(SEPARATOR.findall(x.text)), x.bullet, not x.text.isascii() and "©" in x.text,
            len(DIGIT.findall(x.text)) / size, sum(map(str.isupper, x.text)) / size, "@" in x.key, x.times,
            sum(own) / len(own), min(own), max(own),
            density, m, mean_words, marked, known, depth, math.log1p(below[i]), x.item, nodes[x.parent].fact.share if x.item else -1.0,
            i / n, (n - i) / n, i < first, i > last, i - first, last - i, x.is_title, furniture_before / (i + 1),
            x.words / prev.words if prev else 0, x.words / nxt.words if nxt else 0,
            math.log1p(x.fact.spread), x.fact.share, math.log1p(x.fact.parts),
            prev.fact.share if prev else -1.0, nxt.fact.share if nxt else -1.0, math.log1p(prev.fact.spread) if prev else 0.0, math.log1p(nxt.fact.spread) if nxt else 0.0,
            prev.bullet if prev else 0, nxt.bullet if nxt else 0,
        ]
        for other in (x, prev, nxt):
            row += ONE_HOT[other.kind] if other else NO_KIND
        out[i] = row
        furniture_before += x.kind in FURNITURE
    return out


def weak_labels(page: Page) -> np.ndarray:
    """1 site furniture, 0 content, -1 unknown: what form, structure and recurrence say for sure. Only training uses this."""
    nodes = page.nodes
    out = np.full(len(nodes), -1)
    for i, x in enumerate(nodes):
        nxt = nodes[i + 1] if i + 1 < len(nodes) else None
        before_text = nxt is not None and nxt.kind in ("prose", "common") and not nxt.bullet
        if x.kind in FURNITURE:
            out[i] = 1
        elif x.is_title:
            out[i] = 0
        elif x.kind == "prose":
            if x.fact.spread < UNSURE and x.words > 3:
                out[i] = 0
        elif x.item:
            if x.bullet or x.item > 1 or (nxt is not None and nxt.item > 1):
                out[i] = 1
        elif before_text and not x.bullet and (x.kind == "common" and x.fact.share < DOUBTFUL or x.kind != "common" and x.fact.spread < MANY):
            out[i] = 0
    return out


#: Cost in log odds of keeping content inside a block that is furniture as a whole.
SPLIT_COST = 1.5


def decode(page: Page, prob: np.ndarray) -> np.ndarray:
    """True for furniture: the likeliest labels of page, blocks and lines without contradiction. A block is furniture with all its lines, or content with each line's better label; below a line that is furniture everything is (items of a list below its head)."""
    p = np.clip(prob, 1e-6, 1 - 1e-6)
    yes, no = np.log(p), np.log(1 - p)
    nodes = page.nodes
    # whole[i]: all of i's subtree is furniture; best[i]: the best labels of i's subtree. Items follow their heads, so backwards is bottom-up.
    whole, best = yes.copy(), np.zeros(len(p))
    below_whole, below_best = np.zeros(len(p)), np.zeros(len(p))
    content = np.zeros(len(p), dtype=bool)
    for i in range(len(p) - 1, -1, -1):
        whole[i] = yes[i] + below_whole[i]
        as_content = no[i] + below_best[i]
        content[i] = as_content > whole[i]
        best[i] = max(as_content, whole[i])
        up = nodes[i].parent
        if nodes[i].item and up >= 0:
            below_whole[up] += whole[i]
            below_best[up] += best[i]
    out = np.zeros(len(p), dtype=bool)
    for block in page.blocks:
        tops = [i for i in block if not nodes[i].item or nodes[nodes[i].parent].block != nodes[i].block]
        mixed = bool(content[block].any() and not content[block].all())
        if sum(whole[i] for i in tops) >= sum(best[i] for i in tops) - SPLIT_COST * mixed:
            out[block] = True
            continue
        for i in block:
            up = nodes[i].parent
            out[i] = not content[i] or (nodes[i].item > 0 and up >= 0 and out[up])
    return out


@dataclass
class PageModel:
    trees: BoostedTrees
    tokens: dict[str, float]

    def predict(self, pages: list[Page]) -> np.ndarray:
        return self.trees.predict(np.concatenate([features(p, self.tokens) for p in pages]))


def _token_odds(pages: list[tuple[Page, np.ndarray]], least: int = 3) -> dict[str, float]:
    """Log odds of furniture for each word of labelled lines, a page's equal lines once; words on fewer than ``least`` pages are left out."""
    n = {0: 0, 1: 0}
    seen: dict[str, list[int]] = {}
    for page, y in pages:
        done = set()
        for x, label in zip(page.nodes, y.tolist()):
            if label >= 0 and x.key not in done:
                done.add(x.key)
                for w in set(tokens_of(x.key)):
                    seen.setdefault(w, [0, 0])[label] += 1
                n[label] += 1
    return {w: math.log((b + 0.5) / (n[1] + 1)) - math.log((a + 0.5) / (n[0] + 1)) for w, (a, b) in seen.items() if a + b >= least}


def train(sample: pd.DataFrame, rounds: int = 60) -> PageModel:
    """Boosted trees from the weak labels of pages with columns text, host, known.

    Each page is shown twice: with all that the collection says of its lines, and with half of that hidden, so that lines which are seen nowhere else are judged by form and place.
    Words' log odds are learned from the other half of the pages than those they are shown with.
    """
    full: list[tuple[Page, np.ndarray]] = []
    hidden: list[Page] = []
    for r in sample.itertuples(index=False):
        facts = facts_of(r.known)
        page = parse_page(r.text, r.host or "", facts)
        if page.nodes:
            full.append((page, weak_labels(page)))
            hidden.append(parse_page(r.text, r.host or "", {k: f for k, f in facts.items() if (k ^ (k >> 17)) % 2}))
    xs, ys = [], []
    for half in (0, 1):
        tokens = _token_odds(full[1 - half :: 2])
        for (page, y), other in zip(full[half::2], hidden[half::2]):
            for p in (page, other):
                xs.append(features(p, tokens)[y >= 0])
                ys.append(y[y >= 0])
    x = np.concatenate(xs) if xs else np.zeros((0, FEATURES))
    y = np.concatenate(ys) if ys else np.zeros(0)
    return PageModel(fit(x, y.astype(float), rounds=rounds), _token_odds(full))


def facts_of(known) -> dict[int, Fact]:
    rows = [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in known] if known is not None else []
    return {k: Fact(spread, share, parts) for k, spread, share, parts in rows}


def _line_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, hosts, keys, marks, parts = [], [], [], [], []
        for doc, host, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            short = (host or "").removeprefix("www.")
            lines = [x for x in text.split("\n") if x.strip()]
            own = {line_key(x, short) for x in lines}
            entries = {line_key(e, short) for x in lines for e in menu_parts(BULLET.sub("", x))}
            if not own:
                continue
            both = [*own, *entries]
            ids += [doc] * len(both)
            hosts += [host] * len(both)
            keys += map(line_hash, both)
            marks += [text_mark(own)] * len(both)
            parts += [False] * len(own) + [True] * len(entries)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(marks, pa.int64()), pa.array(parts, pa.bool_())], names=["id", "host", "key", "mark", "part"])


def line_facts(lines: DataFrame) -> DataFrame:
    """(key, spread, share, parts) of lines (id, h, key, mark, part) that stand beside two texts or more.

    ``share``: of all pairs of a page with the line and another page of its host, the part in which the other page has it, too; it doesn't grow with the collection.
    All counts are combined in the map tasks; a host's pages are never gathered.
    """
    texts = lines.groupBy("key", "mark").agg(F.max((~F.col("part")).cast("int")).alias("own"), F.max(F.col("part").cast("int")).alias("entry"))
    texts = texts.groupBy("key").agg(F.sum("own").cast("int").alias("spread"), F.sum("entry").cast("int").alias("parts")).where("spread > 1 OR parts > 1")
    on_host = lines.where("h IS NOT NULL AND NOT part")
    sizes = on_host.select("h", "id").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("pages")).where("pages > 1")
    counts = on_host.select("h", "key", "id").distinct().groupBy("h", "key").agg(F.count(F.lit(1)).alias("n"))
    n, pages = F.col("n"), F.col("pages")
    share = counts.join(sizes, "h").groupBy("key").agg((F.sum(n * (n - 1)) / F.sum(n * (pages - 1))).alias("share"))
    return texts.join(share, "key", "left").select("key", "spread", F.coalesce("share", F.lit(-1.0)).alias("share"), "parts")


def page_lines(pages: DataFrame, *, train_pages: int = 1000) -> DataFrame:
    """(id, line, boilerplate, probability) for each non-blank line of ``pages`` (id BIGINT, host STRING, text STRING), lines from 0.

    1. Lines of any length (numbers and the host's name masked) are counted over all pages: the different texts they stand beside (``text_mark``, so that a copied
       article isn't taken for furniture), and how regularly the pages of a host share them. Only hashes are shuffled (and kept in ``spark.checkpoint.dir``); the
       lines' facts come back to their pages as a small map.
    2. Gradient-boosted trees over the nodes of each page's tree: text density of subtrees, depth, siblings, place, word tokens, recurrence. No list of phrases is involved: they are
       trained here on weak labels from form, structure and recurrence of at most ``train_pages`` pages (those with the smallest hashes of the id; the bound of the fit), and applied to all.
    3. Hierarchical decoding: no line of a block judged furniture, and nothing below a furniture line, is kept.

    A heading that at least half of the pages of every host share can't be told from a template by this and counts as one.

    NULL ids or texts give no rows, a NULL host is a host without other pages, blank texts have no lines. Repeated rows give repeated results.
    """
    pages = pages.select(F.col("id").cast("long").alias("id"), F.col("host").cast("string").alias("host"), F.col("text").cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    lines = pages.mapInArrow(_line_keys, "id long, host string, key long, mark long, part boolean")
    # hashes only, stored: several counts read them, and texts are cut into lines once
    lines = stored(lines.select("id", F.xxhash64("host").alias("h"), F.col("host").isNotNull().alias("hosted"), "key", "mark", "part")).withColumn("h", F.when(F.col("hosted"), F.col("h"))).drop("hosted")
    known = lines.where("NOT part").select("id", "key").join(line_facts(lines), "key")
    known = stored(known.groupBy("id").agg(F.collect_set(F.struct("key", "spread", "share", "parts")).alias("known")))
    picked = F.broadcast(pages.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(train_pages))
    sample = pages.join(picked, "id", "left_semi").join(known.join(picked, "id", "left_semi"), "id", "left")
    model = train(sample.orderBy(F.xxhash64("id"), "id", "text").limit(train_pages).select("text", "host", "known").toPandas())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500).to_pydict()
                parsed = [(doc, parse_page(text, host or "", facts_of(known))) for doc, host, text, known in zip(*(b[x] for x in ("id", "host", "text", "known")))]
                parsed = [(doc, page) for doc, page in parsed if page.nodes]
                if not parsed:
                    continue
                prob = model.predict([page for _, page in parsed])
                ids, lines, flags, at = [], [], [], 0
                for doc, page in parsed:
                    m = len(page.nodes)
                    flags.append(decode(page, prob[at : at + m]))
                    at += m
                    ids += [doc] * m
                    lines += [x.at for x in page.nodes]
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(lines, pa.int32()), pa.array(np.concatenate(flags)), pa.array(prob)], names=["id", "line", "boilerplate", "probability"])

    return pages.join(known, "id", "left").select("id", "host", "text", "known").mapInArrow(judge, "id long, line int, boilerplate boolean, probability double")
