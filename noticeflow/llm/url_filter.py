"""URL filter: rules by host and path, and gradient-boosted trees on lexical features for the rest.

Rules: a rule is ``[host]/path`` with a verdict; it fits its host and all subdomains if the url's path starts
with the rule's. The longest rule that fits decides. Urls that no rule fits are judged by the trees.

Host and path: the host runs from after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path
from there to ``?``, ``#`` or the end. A null url, or one without ``://``, has neither.

Trees: regression trees on binned features, fitted to the gradients of the logistic loss, in numpy on the
driver, from at most MAX_ROWS labelled urls. Features are lexical only: lengths, depth, digit ratios, entropy,
parameters, hyphens, and statistics of the suffix (the last label of the host): how many of the training
urls have it and how many of those are to be blocked. Urls are lower-cased before, so case decides nothing.

Labelled urls come from a table (``labelled``) or, where there is none, from ``seed_urls()``: many kinds of urls as they
are found on the web, on either side: names of one or several words with and without hyphens, subdomains, ports, ip
hosts, slugs, dates, ids, files, hashes, sign-ins, redirects, sessions, campaigns. What tells the sides apart is how often each
trait occurs: every kind of name, path and parameter is drawn on both.

Ties: of rules of one length that fit the one later by code point decides; a score of 0.5 blocks. Urls are judged one
by one in column expressions and one Arrow step; there is no shuffle. Null ids and repeated rows are judged like others;
very long urls are read whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.textkit import column, tidy

ALLOW, BLOCK = "allow", "block"
MAX_ROWS = 20000
MAX_BINS = 32


def host_of(url: Column) -> Column:
    rest = F.substr(url, F.locate("://", url) + 3)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.locate("://", url) > 0, host).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substr(url, F.locate("://", url) + 3)
    return F.when(F.locate("://", url) > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def fits(rule: str, host: Column, path: Column) -> Column:
    """rule: host, a slash and what the path must start with after its own slash."""
    name, _, start = rule.partition("/")
    return ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))


def rule_of(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, word in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        ok = fits(name, host, path)
        rule, verdict = F.when(ok, F.lit(name)).otherwise(rule), F.when(ok, F.lit(word)).otherwise(verdict)
    return rule, verdict


FEATURES = ("length", "host_length", "path_length", "query_length", "labels", "depth", "params", "digits", "host_digits", "entropy", "host_entropy", "hyphens", "host_hyphens", "longest_label", "vowels", "escapes", "file_suffix", "suffix_seen", "suffix_blocked")


def _entropy(data: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Bits a byte of each row's bytes."""
    counts = np.bincount(row * 256 + data, minlength=rows * 256).reshape(rows, 256)
    total = counts.sum(1)
    share = counts / np.maximum(total, 1)[:, None]
    return -np.where(counts > 0, share * np.log2(np.where(counts > 0, share, 1)), 0).sum(1)


def lexical(urls: list[str | None]) -> tuple[np.ndarray, list[str]]:
    """Features of urls but for their suffixes, and the suffixes. Urls are lower-cased first and lengths are bytes.

    All urls are one array of bytes; a position of a kind at or after another is found in the sorted positions of that kind,
    and numbers of a kind between two positions are differences of running counts.
    """
    texts = [(u or "").lower().encode("utf-8", "replace") for u in urls]
    n = len(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(lengths)
    begin = end - lengths
    data = np.frombuffer(b"".join(texts), np.uint8)
    row = np.repeat(np.arange(n), lengths)
    is_ = lambda chars: np.isin(data, np.frombuffer(chars.encode(), np.uint8))

    def first(where: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The first position in [start, stop), or stop."""
        at = np.flatnonzero(where)
        k = np.searchsorted(at, start)
        return np.minimum(np.append(at, data.size)[k], stop)

    def last(where: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The last position in [start, stop), or start - 1."""
        at = np.flatnonzero(where)
        k = np.searchsorted(at, stop) - 1
        return np.maximum(np.where(k >= 0, np.append(at, -1)[k], -1), start - 1)

    def count(where: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        running = np.append(0, np.cumsum(where))
        return running[stop] - running[np.minimum(start, stop)]

    slash, dot, digit, hyphen = is_("/"), is_("."), is_("0123456789"), is_("-")
    scheme = np.zeros(data.size, bool)
    if data.size > 2:
        scheme[:-2] = is_(":")[:-2] & slash[1:-1] & slash[2:] & (row[:-2] == row[2:])
    found = first(scheme, begin, end)
    host = np.where(found < end, found + 3, end)  # without a scheme there is neither host nor path
    host_end = first(is_("/?#"), host, end)
    tail_end = first(is_("#"), host_end, end)
    mark = first(is_("?"), host_end, tail_end)
    query = np.minimum(mark + 1, tail_end)
    opens = slash.copy()  # a slash that a part of the path follows
    if data.size:
        opens[:-1] &= ~slash[1:] & (row[:-1] == row[1:])
        opens[-1] = False
    depth = count(opens, host_end, np.maximum(mark - 1, host_end))
    stops = np.concatenate([host - 1, host_end, np.flatnonzero(dot & (np.arange(data.size) >= host[row]) & (np.arange(data.size) < host_end[row]))])
    of = np.concatenate([np.arange(n), np.arange(n), row[stops[2 * n :]]])
    order = np.lexsort((stops, of))
    gaps, own = np.diff(stops[order]) - 1, of[order]
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, own[1:][own[1:] == own[:-1]], gaps[own[1:] == own[:-1]])
    name = last(slash, host_end, mark) + 1  # of the file
    file_dot = last(dot, name, mark)
    in_host = (np.arange(data.size) >= host[row]) & (np.arange(data.size) < host_end[row])
    width = np.maximum(1, host_end - host)
    equals = count(is_("="), query, tail_end)
    columns = [
        lengths, host_end - host, mark - host_end, tail_end - query, count(dot, host, host_end) + 1, depth, np.where(equals > 0, equals, tail_end > query), count(digit, begin, end) / np.maximum(1, lengths), count(digit, host, host_end) / width,
        _entropy(data, row, n), _entropy(data[in_host], row[in_host], n), count(hyphen, begin, end), count(hyphen, host, host_end), longest, count(is_("aeiou"), host, host_end) / width, count(is_("%"), begin, end),
        np.where(file_dot >= name, mark - file_dot - 1, 0),
    ]
    return np.stack(columns, 1).astype(float) if n else np.zeros((0, len(columns))), [t[h - b0 : e - b0].rpartition(b".")[2].decode("utf-8", "replace") for t, b0, h, e in zip(texts, begin.tolist(), host.tolist(), host_end.tolist(), strict=True)]


@dataclass
class Trees:
    """suffixes: of the training urls, with how many have each and how many of these are blocked."""

    base: float
    trees: list[list[tuple]]  # nodes: (feature, threshold, left, right) or (value,)
    suffixes: dict[str, tuple[int, int]]
    rows: int

    def matrix(self, urls: list[str | None]) -> np.ndarray:
        own, suffixes = lexical(urls)
        seen, blocked = np.array([self.suffixes.get(x, (0, 0)) for x in suffixes], float).reshape(-1, 2).T
        return np.column_stack([own, seen / max(1, self.rows), (blocked + 1) / (seen + 2)])

    def score(self, urls: list[str | None]) -> np.ndarray:
        """Probability that each url is to be blocked."""
        x = self.matrix(urls)
        z, every = np.full(len(x), self.base), np.arange(len(x))
        for tree in self.trees:  # a leaf leads to itself, with its value for a threshold
            feature, cut, left, right = (np.array(c) for c in zip(*(node if len(node) > 1 else (-1, node[0], k, k) for k, node in enumerate(tree)), strict=True))
            at = np.zeros(len(x), int)
            while (feature[at] >= 0).any():
                at = np.where(x[every, feature[at]] <= cut[at], left[at], right[at])
            z += cut[at]
        return 1 / (1 + np.exp(-z))


def _grow(codes: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rate: float, depth: int, least: int, ridge: float = 1.0) -> tuple[list[tuple], np.ndarray]:
    nodes: list[tuple] = []
    value = np.zeros(len(g))
    bins = max(len(e) for e in edges) + 1
    offset = np.arange(codes.shape[1]) * bins

    def grow(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        nodes.append(())
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, -1, -1)
        if level < depth and len(rows) >= 2 * least:
            flat = (codes[rows] + offset).ravel()
            left_g, left_h, left_n = (np.cumsum(np.bincount(flat, np.repeat(w, codes.shape[1]), codes.shape[1] * bins).reshape(-1, bins), 1) for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - total_g**2 / (total_h + ridge)
            gain[(left_n < least) | (len(rows) - left_n < least)] = -1
            f, k = divmod(int(gain.argmax()), bins)
            if gain[f, k] > best[0]:
                best = (gain[f, k], f, k)
        if best[1] < 0:
            nodes[me] = (-rate * total_g / (total_h + ridge),)
            value[rows] = nodes[me][0]
            return me
        _, f, k = best
        left = codes[rows, f] <= k
        a, b = grow(rows[left], level + 1), grow(rows[~left], level + 1)
        nodes[me] = (f, float(edges[f][k]), a, b)
        return me

    grow(np.arange(len(g)), 0)
    return nodes, value


def fit(rows: list[tuple[str, int]], n_trees: int = 60, depth: int = 4, rate: float = 0.2, least: int = 8, max_rows: int = MAX_ROWS) -> Trees:
    """rows: urls with 1 (block) or 0 (allow); the first max_rows are used."""
    rows = rows[:max_rows]
    y = np.array([int(b) for _, b in rows], float)
    seen: Counter = Counter()
    blocked: Counter = Counter()
    for suffix, (_, b) in zip(lexical([u for u, _ in rows])[1], rows, strict=True):
        seen[suffix] += 1
        blocked[suffix] += int(b)
    model = Trees(0.0, [], {s: (c, blocked[s]) for s, c in seen.items()}, len(rows))
    if not len(rows) or y.min() == y.max():
        model.base = 20.0 if len(rows) and y.min() == 1 else -20.0
        return model
    x = model.matrix([u for u, _ in rows])
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, MAX_BINS + 1)[1:-1], method="lower")) for c in x.T]
    codes = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    model.base = math.log(y.mean() / (1 - y.mean()))
    z = np.full(len(y), model.base)
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-z))
        tree, step = _grow(codes, edges, p - y, np.maximum(p * (1 - p), 1e-6), rate, depth, least)
        model.trees.append(tree)
        z += step
    return model


def labelled(urls: DataFrame, max_rows: int = MAX_ROWS) -> list[tuple[str, int]]:
    """Labelled urls of a table (url, label: 1 block, 0 allow) for fit(): the max_rows least by a hash of the url."""
    rows = urls.select(F.col("url").cast("string").alias("url"), F.col("label").cast("int").alias("label")).dropna()
    return [(r.url, int(r.label > 0)) for r in rows.orderBy(F.xxhash64("url"), "url", "label").limit(max_rows).collect()]


# Words of the labelled urls that the rule below draws: no feature knows them.
TOPICS = (
    "news science travel garden music history weather kitchen library museum sports school health energy forum photo market nature city river mountain recipe film art game tech data code open world daily local north south house book "
    "wiki guide press review journal academy bank insurance university hospital council studio radio coffee bicycle car boat train ticket shop store law tax math physics space ocean forest bird dog cat horse wine bread tea"
).split()
LURES = "free win bonus casino bet pills cheap replica loan prize gift verify secure account login update support wallet crypto invest deal hot adult date click promo crack keygen torrent stream full download".split()
PLACES = "docs blog support accounts login developer m shop news api mail my secure en de static play store maps account help community learn research data".split()
COMMON, ABUSED = ("com", "com", "com", "com", "com", "com", "org", "org", "org", "net", "de", "fr", "es", "it", "uk", "edu", "gov", "io", "info", "eu"), ("top", "xyz", "click", "icu", "live", "info", "ru", "cn", "loan", "win", "com", "net")
LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _sounds(r: random.Random, a: int, b: int) -> str:
    """A made-up name that can be spoken."""
    return "".join(r.choice("bcdfghjklmnprstvwz") + r.choice(("a", "e", "i", "o", "u", "oo", "ea")) + r.choice(("", "", "n", "r", "s", "l", "x")) for _ in range(r.randint(a, b)))


def _noise(r: random.Random, a: int, b: int) -> str:
    return "".join(r.choices(LETTERS + DIGITS, k=r.randint(a, b)))


def _name(r: random.Random, bad: bool) -> str:
    """What stands before the suffix. Each kind is on either side, but not as often."""
    kind = r.choices(("words", "made up", "short", "lures", "noise", "mixed", "foreign", "numbered"), (6, 5, 4, 0.3, 0.15, 0.1, 0.1, 0.4) if not bad else (0.8, 0.7, 0.3, 4, 3, 2, 1, 1.5))[0]
    words = r.choices(TOPICS, k=r.choice((1, 1, 2, 2, 3)))
    if kind == "words":
        return r.choice(("-", "", "", "")).join(words)
    if kind == "made up":
        return _sounds(r, 1, 4) + r.choice(("", "", "", r.choice(TOPICS)))
    if kind == "short":
        return "".join(r.choices(LETTERS, k=r.randint(1, 5))) + r.choice(("", "", "", "", r.choice(DIGITS)))
    if kind == "lures":
        return r.choice(("-", "-", "")).join(r.sample(LURES, r.choice((2, 2, 3) if bad else (1, 1, 2)))) + (r.choice(("", str(r.randint(1, 9999)))) if bad else "")
    if kind == "noise":
        return _noise(r, 9, 24)
    if kind == "mixed":
        return f"{r.choice(LURES)}-{r.choice(words)}-{r.choice(LURES)}{r.randint(0, 99)}"
    if kind == "foreign":
        return "xn--" + _noise(r, 6, 14)
    return r.choice(("-", "")).join(words) + str(r.randint(1, 99999 if bad else 365))


def _host(r: random.Random, bad: bool) -> str:
    if r.random() < (0.08 if bad else 0.01):
        return ".".join(str(r.randint(1, 254)) for _ in range(4)) + r.choice(("", "", ":8080"))
    suffix = r.choice(ABUSED if r.random() < (0.75 if bad else 0.04) else COMMON)
    below = r.choice(("", "", "www.", "www.", "www.", f"{r.choice(PLACES)}.", f"{r.choice(PLACES)}.", f"{r.choice(TOPICS)}.", f"{r.choice(PLACES)}.{r.choice(PLACES)}."))
    if r.random() < (0.35 if bad else 0.02):
        below = r.choice((".", "-")).join([*r.sample(LURES, r.randint(1, 3)), *r.choices((_sounds(r, 2, 3), "com"), k=r.randint(0, 2))]) + "."
    middle = r.choice(("", ".co", ".co", ".ac", ".gov")) if suffix == "uk" else ""
    return below + _name(r, bad) + middle + "." + suffix + ("" if r.random() < 0.98 else r.choice((":443", ":8080")))


def _part(r: random.Random) -> str:
    """One part of an ordinary path."""
    words = r.choices(TOPICS, k=r.randint(1, 7))
    return r.choice((
        r.choice(TOPICS), r.choice(TOPICS), "-".join(words), "-".join(words), "_".join(words), "-".join(words) + f"-{r.randint(1, 10**8)}", str(r.randint(1, 10 ** r.randint(2, 9))), f"{r.randint(1999, 2026)}/{r.randint(1, 12):02d}",
        f"{r.randint(1999, 2026)}/{r.randint(1, 12):02d}/{r.randint(1, 28):02d}", r.choice(("en", "de", "fr", "es", "en-us", "tag", "category", "article", "p", "dp", "wiki", "search", "status", "user", "questions", "latest", "v2", "login", "signin", "account")),
        r.choice(TOPICS) + r.choice((".html", ".php", ".htm", ".pdf", ".aspx")), f"{r.choice(('a', 'pmc', 'b0', 'id', 'cve-2024-'))}{r.randint(100, 10**7)}", _sounds(r, 2, 4), f"{_sounds(r, 2, 3)}/{_sounds(r, 2, 3)}", f"{words[0]}_({r.choice(TOPICS)})", f"{words[0]}%20{words[-1]}",
    ))


def _tail(r: random.Random, bad: bool) -> str:
    """Path, parameters and fragment. Random text, lures, sign-ins and redirects are on either side."""
    parts = [_part(r) for _ in range(r.choice((0, 1, 1, 2, 2, 3, 4)))]
    if r.random() < (0.55 if bad else 0.14):
        parts += [r.choice((_noise(r, 12, 40), r.choice(LURES) + _noise(r, 2, 9), "~" + _noise(r, 5, 9), "wp-content/" + _noise(r, 6, 12) + ".php") if bad else (_noise(r, 6, 12), _noise(r, 10, 12), "".join(r.choices("abcdef" + DIGITS, k=40)))) for _ in range(r.randint(1, 4) if bad else 1)]
    path = ("/" + "/".join(parts) if parts else "") + r.choice(("", "", "/"))
    pairs = [r.choice((f"page={r.randint(1, 40)}", f"id={r.randint(1, 10**6)}", f"q={r.choice(TOPICS)}", f"q={'+'.join(r.choices(TOPICS, k=3))}", f"v={_noise(r, 11, 11)}", "utm_source=feed", "lang=en", f"ref={r.choice(TOPICS)}")) for _ in range(r.choice((0, 0, 0, 0, 1, 1, 2, 3)))]
    if r.random() < (0.45 if bad else 0.08):
        far = f"{_noise(r, 6, 12)}.{r.choice(ABUSED)}" if bad else f"{r.choice(PLACES)}.{_sounds(r, 2, 3)}.com%2f{r.choice(TOPICS)}"
        pairs += [r.choice((f"{r.choice(('redirect', 'continue', 'return_to', 'url'))}=https%3a%2f%2f{far}", f"sid={_noise(r, 24, 64)}", f"aff={r.randint(1, 10**8)}", f"token={_noise(r, 16, 40)}%3d")) for _ in range(r.randint(1, 4) if bad else r.randint(1, 2))]
    return path + ("?" + "&".join(pairs) if pairs else "") + r.choice(("", "", "", "#top", "#" + r.choice(TOPICS)))


def seed_urls(n: int = 12000, seed: int = 5) -> list[tuple[str, int]]:
    """Labelled urls by rule: half to be blocked (1), half to be allowed (0)."""
    r = random.Random(seed)
    return [(r.choice(("http", "https", "https")) + "://" + _host(r, bool(i % 2)) + _tail(r, bool(i % 2)), i % 2) for i in range(n)]


@functools.lru_cache(maxsize=1)
def default_trees() -> Trees:
    """Trees fitted to seed_urls(), once a process."""
    return fit(seed_urls())


def judged(pages: DataFrame, rules: list[tuple[str, str]], model: Trees, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, url, host, path, rule, p_block (by the trees, for every url), verdict."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = column(batch, "url")
            for i in range(0, len(urls), 4096):
                yield pa.RecordBatch.from_arrays([column(batch, "id").slice(i, 4096), urls.slice(i, 4096), pa.array(shared.value.score(urls.slice(i, 4096).to_pylist()))], ["id", "url", "p_block"])

    scored = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url")).mapInArrow(tidy(run), "id long, url string, p_block double")
    placed = scored.withColumn("host", F.coalesce(host_of(F.col("url")), F.lit(""))).withColumn("path", F.coalesce(path_of(F.col("url")), F.lit("")))
    rule, verdict = rule_of(rules, F.col("host"), F.col("path"))
    own = F.when(F.col("p_block") >= 0.5, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return placed.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "host", "path", rule.alias("rule"), "p_block", F.coalesce(verdict, own).alias("verdict"))
