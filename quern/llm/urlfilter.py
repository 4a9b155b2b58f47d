"""URL filters: explicit rules first, then a logistic regression on hashed character n-grams.

The model reads the host and the path, each between marks, as character n-grams of three
to five characters, hashed to 2^16 places that are kept apart for host and path.  It is
fitted by Newton-free gradient descent on a small labelled table of URLs, by default the
one below, and is a vector of 2^16 numbers, which is what workers get.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BITS = 16
GRAMS = (3, 4, 5)
#: Characters of urls whose n-grams are hashed in one go, or a single longer url.
RUN_CHARACTERS = 500_000

#: A small labelled table: (url, 1 for block).
LABELLED = [
    ("https://www.casino-royal.example.com/slots/free-spins", 1),
    ("http://online-casino.example.net/win/jackpot", 1),
    ("https://casino-bonus.example.org/en/poker", 1),
    ("https://m.casino-win.example.net/de/12", 1),
    ("http://best-bets.example.com/odds/today", 1),
    ("https://free-bets.example.net/en/42.html", 1),
    ("https://sports-bets.example.org/en/free", 1),
    ("https://bets-online.example.com/fr/9", 1),
    ("http://cheap-pills.example.com/viagra/order", 1),
    ("https://www.pills-shop.example.net/cialis", 1),
    ("https://cheap-meds.example.org/en/pills/77", 1),
    ("http://discount-pills.example.org/es/3", 1),
    ("https://adult-videos.example.com/xxx/clips", 1),
    ("http://adult-chat.example.net/sex/cams", 1),
    ("https://xxx-adult.example.org/en/porn", 1),
    ("https://www.adult-x.example.com/en/5", 1),
    ("http://free-porn.example.com/xxx", 1),
    ("https://ads-server.example.net/banner/click", 1),
    ("http://track-ads.example.com/pixel?id=3", 1),
    ("https://ads-track.example.org/en/1", 1),
    ("https://tracking.example.net/ads/click.html", 1),
    ("http://popup-ads.example.org/fr/55", 1),
    ("https://spam-links.example.com/buy/backlinks", 1),
    ("http://link-farm.example.net/spam/123", 1),
    ("https://spam-farm.example.org/en/8", 1),
    ("https://www.spam-offers.example.com/es/free-money", 1),
    ("http://cheap-replica.example.com/watches/buy-now", 1),
    ("https://free-money.example.net/win/prize", 1),
    ("http://win-prize.example.org/en/free/gift-card", 1),
    ("https://payday-loans.example.com/cheap/fast-cash", 1),
    ("https://malware-download.example.net/crack/keygen.exe", 1),
    ("http://warez-crack.example.org/serial/free", 1),
    ("https://www.example.com/en/about", 0),
    ("https://news.example.com/en/2023/05/politics", 0),
    ("https://blog.sunrise.example.com/en/843", 0),
    ("http://www.thehill.example.net/de/5120.html", 0),
    ("https://m.ontario.example.org/fr/77?page=2", 0),
    ("https://library.example.org/en/books/12", 0),
    ("http://university.example.net/research/papers", 0),
    ("https://docs.example.com/en/guide/install.html", 0),
    ("https://weather.example.net/es/today", 0),
    ("https://wiki.example.org/en/Mathematics", 0),
    ("http://blog.morning.example.org/en/3233.html", 0),
    ("https://shop.northern.example.com/fr/products/5", 0),
    ("https://www.interest.example.net/en/990/", 0),
    ("http://tionstone.example.com/en/4412", 0),
    ("https://m.ththere.example.net/en/25#top", 0),
    ("https://thinghouse.example.org/de/685", 0),
    ("https://blog.thatered.example.com/en/853/", 0),
    ("http://stathaer.example.net/es/960", 0),
    ("https://ernation.example.com/en/1", 0),
    ("https://www.enthand.example.org/fr/7009.html", 0),
    ("https://museum.example.com/en/exhibits/3", 0),
    ("http://health.example.org/en/articles/sleep", 0),
    ("https://garden.example.net/de/plants/88", 0),
    ("https://recipes.example.com/en/soup.html", 0),
    ("https://travel.example.org/es/madrid/2", 0),
    ("http://science.example.net/en/physics/14?ref=x", 0),
    ("https://music.example.com/fr/albums/31", 0),
    ("https://school.example.org/en/lessons/6", 0),
    ("https://adventure.example.com/en/trips/9", 0),
    ("https://www.bethany.example.org/en/church", 0),
    ("https://thadsen.example.net/en/640", 0),
    ("https://winter.example.com/de/ski/4", 0),
    ("", 0),
    ("no address at all", 0),
    ("https://", 0),
    ("https://a.example.com", 0),
]

#: Rules of the query: (host, path, verdict).
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def _places(data: np.ndarray, at: np.ndarray, n: int, part: int) -> np.ndarray:
    """Hashed places of the n-grams of bytes that start at ``at``, by CRC-32."""
    crc = np.full(len(at), 0xFFFFFFFF ^ (part * 0x5BD1E995 & 0xFFFFFFFF), np.uint32)
    for i in range(n):
        crc = _CRC[(crc ^ data[at + i]) & 0xFF] ^ (crc >> np.uint32(8))
    return ((crc ^ (crc >> np.uint32(16))) & np.uint32((1 << BITS) - 1)).astype(np.int64)


def places(text: str, part: int) -> np.ndarray:
    """Hashed places of a host's (part 0) or path's (part 1) n-grams of UTF-8 bytes."""
    data = np.frombuffer(b"\x02" + text.encode("utf-8", "surrogatepass") + b"\x03", np.uint8)
    return np.concatenate([_places(data, np.arange(max(0, len(data) - n + 1)), n, part) for n in GRAMS])


def features(host: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and their values; the host has length one, the path half of that."""
    at, value = [], []
    for part, text in enumerate((host, path)):
        p = np.unique(places(text, part))
        if len(p):
            at.append(p)
            value.append(np.full(len(p), (1.0, 0.5)[part] / np.sqrt(len(p))))
    return (np.concatenate(at), np.concatenate(value)) if at else (np.empty(0, np.int64), np.empty(0))


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path, as ``host_of`` and ``path_of`` have them."""
    before, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = rest[:end]
    path = rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path[:stop]


class UrlModel:
    """Logistic regression; ``weights`` and ``bias``."""

    def __init__(self, labelled: Sequence[tuple[str, int]] = LABELLED, l2: float = 1e-4, steps: int = 1500, rate: float = 4.0):
        rows = [features(*split_url(u)) for u, _ in labelled]
        y = np.array([v for _, v in labelled], float)
        x = np.zeros((len(rows), 1 << BITS))
        for i, (at, value) in enumerate(rows):
            np.add.at(x[i], at, value)
        used = np.flatnonzero(x.any(0))
        x = x[:, used]
        w, b = np.zeros(len(used)), 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(x @ w + b)))
            w -= rate * (x.T @ (p - y) / len(y) + l2 * w)
            b -= rate * (p - y).mean()
        self.weights = np.zeros(1 << BITS)
        self.weights[used] = w
        self.bias = float(b)

    def score(self, host: str, path: str) -> float:
        at, value = features(host, path)
        return float(1 / (1 + np.exp(-(self.weights[at] @ value + self.bias))))

    def scores(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """``score`` of each host and path, with the n-grams of all of them hashed at once."""
        n, keys = len(hosts), []
        for part, texts in enumerate((hosts, paths)):
            coded = [b"\x02" + t.encode("utf-8", "surrogatepass") + b"\x03" for t in texts]
            data, size = np.frombuffer(b"".join(coded), np.uint8), np.fromiter(map(len, coded), np.int64, n)
            row, left = np.repeat(np.arange(n), size), np.repeat(np.cumsum(size), size) - np.arange(len(data))
            for g in GRAMS:
                at = np.flatnonzero(left >= g)
                keys.append((row[at] * 2 + part) << BITS | _places(data, at, g, part))
        key = np.unique(np.concatenate(keys))
        place, owner = key & ((1 << BITS) - 1), key >> BITS
        value = np.where(owner & 1, 0.5, 1.0) / np.sqrt(np.bincount(owner, minlength=2 * n))[owner]
        return 1 / (1 + np.exp(-(np.bincount(owner >> 1, self.weights[place] * value, n) + self.bias)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null where none does.

    A rule fits its host and all subdomains if the path starts with its path.  Of equally
    long rules the first in the order of their text counts.  Rules are a short list of
    literals: one expression, no join.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(df: DataFrame, url_col: str = "url", id_col: str = "page_id", rules: Sequence[tuple[str, str, str]] = RULES, model: UrlModel | None = None, threshold: float = 0.5) -> DataFrame:
    """(id_col, host, path, rule, verdict, score) of each row.

    The verdict is the longest fitting rule's, else ``block`` where the model's score is
    at least ``threshold``.  A null url, or one without ``://``, has an empty host and path,
    no rule, and the model's score of nothing but its bias.  Very long urls are read whole;
    rows that repeat an id are judged each by its own url; a null id stays null; an empty
    table gives an empty result; other columns are not read.
    """
    model = model or UrlModel()

    def scores(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for hosts, paths in parts:
            out, start, size = [], 0, 0
            hosts, paths = hosts.to_pylist(), paths.to_pylist()
            for i, (h, p) in enumerate(zip(hosts, paths), 1):
                size += len(h) + len(p) + 4
                if size > RUN_CHARACTERS or i == len(hosts):
                    out.append(model.scores(hosts[start:i], paths[start:i]))
                    start, size = i, 0
            yield pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())

    score = F.arrow_udf(scores, "double")
    url = F.col(url_col).cast("string")
    out = df.select(F.col(id_col).alias(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    out = out.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("score", score("host", "path"))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return out.select(id_col, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "score")
