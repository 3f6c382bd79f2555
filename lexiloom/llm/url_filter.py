"""URL filter: host and path rules, and a weighted vocabulary matched by an Aho-Corasick automaton.

A url is judged by the longest rule (host/path) that fits its host or a parent domain and starts its path. Where no rule
fits, terms are counted in the lower-cased url: a hit counts only between characters that are not ASCII letters or digits.
One strict term or `soft_limit` distinct soft terms block the url.

Null urls and those without `://`: empty host and path, verdict allow. Repeated rows are judged alike; only the id and
url columns are read, so other columns' names don't matter; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: The rules of the query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: The default vocabulary; `read_vocabulary` reads another one.
STRICT = (
    "porn", "porno", "pornhub", "xxx", "xxxvideos", "hentai", "camgirl", "camgirls", "camsex", "livecams", "escort", "escorts", "callgirls", "blowjob", "milf",
    "bdsm", "fetish", "hardcore", "nsfw", "onlyfans", "sexcam", "sexcams", "sexshop", "sextube", "upskirt", "voyeur", "casino", "jackpot",
    "roulette", "blackjack", "baccarat", "sportsbook", "bookmaker", "slotmachine", "warez", "malware", "phishing", "spyware", "ransomware", "botnet", "carding",
    "cvv", "fullz", "darkweb", "keylogger", "xanax", "tramadol", "oxycontin", "cialis", "levitra",
)
SOFT = (
    "adult", "adults", "sex", "sexy", "nude", "nudes", "naked", "erotic", "erotica", "dating", "hookup", "hookups", "singles", "lingerie", "webcam", "webcams", "mature",
    "bet", "bets", "betting", "odds", "poker", "slots", "bingo", "lottery", "gamble", "gambling", "wager", "loan", "loans", "payday", "credit", "debt", "forex", "binary",
    "crypto", "airdrop", "crack", "cracked", "cracks", "keygen", "serial", "nulled", "torrent", "torrents", "pirate", "proxy", "unblocked", "pills", "pharmacy", "viagra",
    "steroids", "weightloss", "diet", "detox", "cbd", "replica", "replicas", "rolex", "cheap", "discount", "coupon", "free", "giveaway", "prize", "win", "winner",
    "bonus", "earn", "cash", "click", "track", "tracker", "affiliate", "popup", "redirect", "spam", "seo", "backlinks",
)
SCHEMA = "host string, path string, rule string, verdict string, n_strict long, n_soft long"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return ascii_lower(host), slash + path


def ascii_lower(s: str) -> str:
    return s.lower() if s.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


class Rules:
    """Rules by host, so a url costs one look-up a domain level, however many rules there are."""

    def __init__(self, rules: tuple[tuple[str, str], ...]) -> None:
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(ascii_lower(host), []).append((slash + path, rule, verdict))

    def longest(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        while host:
            for start, rule, verdict in self.by_host.get(host, ()):
                if path.startswith(start) and (best[0] is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
            host = host.partition(".")[2]
        return best


class Vocabulary:
    def __init__(self, strict: tuple[str, ...], soft: tuple[str, ...]) -> None:
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for weight, terms in ((0, soft), (1, strict)):  # a term in both lists is strict
            for term in terms:
                self.machine.add_word(ascii_lower(term), (weight, ascii_lower(term)))
        self.empty = not (strict or soft)
        self.machine.make_automaton() if not self.empty else None

    def hits(self, url: str | None) -> tuple[int, int]:
        """Distinct strict and soft terms."""
        found: set[tuple[int, str]] = set()
        if url and not self.empty:
            s = ascii_lower(url)
            plain = lambda c: c.isascii() and c.isalnum()
            for end, (weight, term) in self.machine.iter(s):
                start = end - len(term) + 1
                if (start == 0 or not plain(s[start - 1])) and (end + 1 == len(s) or not plain(s[end + 1])):
                    found.add((weight, term))
        strict = sum(w for w, _ in found)
        return strict, len(found) - strict


def read_vocabulary(spark: SparkSession, path: str, max_terms: int = 1_000_000) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Strict and soft terms from lines of a term, a tab and `strict` or `soft`. Each task builds the automaton, so more than
    max_terms lines are an error; so are other weights."""
    part = F.split("value", "\t")
    lines = spark.read.text(path).where("value <> ''").select(part[0].alias("term"), F.get(part, F.lit(1)).alias("weight"))
    rows = lines.distinct().limit(max_terms + 1).collect()
    if len(rows) > max_terms:
        raise ValueError(f"more than {max_terms} terms")
    if odd := {r.weight for r in rows} - {"strict", "soft"}:
        raise ValueError(f"weights are strict or soft, not {odd}")
    return tuple(tuple(sorted(r.term for r in rows if r.weight == w)) for w in ("strict", "soft"))


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, strict: tuple = STRICT, soft: tuple = SOFT, soft_limit: int = 2) -> DataFrame:
    """One row a page: id, host, path, rule, verdict (allow or block), n_strict, n_soft."""
    slim = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"))
    kind = slim.schema["page_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_host, terms = Rules(rules), Vocabulary(strict, soft)
        for batch in batches:
            out: list[tuple] = []
            for url in batch.column("url").to_pylist():
                host, path = split_url(url)
                rule, verdict = by_host.longest(host, path)
                n_strict, n_soft = terms.hits(url)
                out.append((host, path, rule, verdict or ("block" if n_strict or n_soft >= soft_limit else "allow"), n_strict, n_soft))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, pa.string()) for c in columns[:4]), *(pa.array(c, pa.int64()) for c in columns[4:])], names=["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft"])

    return slim.mapInArrow(judge, f"page_id {kind}, {SCHEMA}")


def allowed_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", **options: object) -> DataFrame:
    """The pages that the filter allows, with all their columns. Rows of one id stand or fall together."""
    key = fresh(pages, "__id")
    blocked = url_filter(pages, id_col, url_col, **options).where("verdict = 'block'").select(F.col("page_id").alias(key)).distinct()
    return pages.join(blocked, F.col(f"`{id_col}`").eqNullSafe(F.col(key)), "left_anti")
