"""URL filter: rules for hosts and paths, and a logistic regression on character n-grams for the rest.

The model is trained from a small labelled URL table (host, path, blocked), by default ``labelled_urls``; the rules
only override it. It knows the words of that table: most bad hosts of other words pass.

Defined results: a null url, or one without ``://``, has an empty host and path and is judged by the model;
repeated urls get equal verdicts; a labelled table without rows, or with one verdict only, gives the model
that verdict's base rate (no rows: allow). No pages give no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from parcelflow.llm.linear import Sparse, fit_logistic, sigmoid

WIDTH = 1 << 16
SIZES = (2, 3, 4, 5)
#: Most labelled URLs of each verdict that a model is fitted on.
SAMPLE = 8000
#: Share of blocked URLs that a fit assumes, whatever the labelled table's own is: few bad hosts are worth a wrongly blocked one.
SHARE = 0.3
#: Words of the labelled table, by what they are about. ``COMMON_WORDS`` and invented names go with both verdicts.
BAD_WORDS = {
    "gambling": "casino poker roulette jackpot slots bets betting gamble lottery bingo blackjack baccarat sportsbook wager",
    "adult": "adult xxx porn sex escort nude erotic fetish webcams camgirls hookup swingers",
    "pills": "viagra cialis pills pharma steroids xanax tramadol dietpills",
    "malware": "malware phishing keylogger trojan ransomware botnet spyware",
    "piracy": "warez crack cracked keygen torrent torrents serials nulled",
    "ads": "ads adserver adclick tracker tracking telemetry popup popunder banner clickbait affiliate",
    "spam": "spam loans payday cashadvance getrich bitcoin replica forex",
}
#: Ordinary words, and ordinary ones that contain or resemble a bad one.
GOOD_WORDS = """school library museum weather garden history science music cooking travel hospital university council theatre
  railway harbour village mountain river forest bakery kitchen football chess poetry painting physics biology chemistry
  grammar dictionary encyclopedia journal gazette archive recipes knitting cycling hiking sailing astronomy geology
  farming orchard carpenter pottery cinema orchestra parish county station bridge castle island meadow valley winter summer
  energy software research health insurance pharmacy bank market house family"""
LOOKALIKES = """better diabetes sherbet betwixt elizabeth heads roads beads threads downloads adsorption racetrack tractor soundtrack
  crackers firecracker timeslot sloth essex sussex adulthood population popular pillar pillow bannerman loan-library polka spanish"""
COMMON_WORDS = "win free best top online go my one daily club"
PREFIXES, LANGUAGES = ("", "www.", "m.", "blog."), ("en", "de", "fr", "es")
DOMAINS = ("example.com", "example.net", "example.org", "site.info", "seite.de", "portail.fr", "sitio.es", "com", "org", "net", "edu", "biz", "io", "co.uk")
#: Number of invented names, and the parts of their syllables.
INVENTED = 1200
ONSETS, VOWELS, CODAS = "b br c ch d dr f fl g gr h j k l m n p pl qu r s sh st t th tr v w y z".split(), "a e i o u ea ai ou".split(), ["", "", "n", "r", "l", "s", "t", "nd", "ck"]
A_TO_Z, A_TO_Z_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case) and path (from there to ``?`` or ``#``)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), A_TO_Z, A_TO_Z_LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest of the rules (verdict, host, path) that fits, as struct(rule, verdict), else null.

    A rule fits its host and all subdomains if the path starts with the rule's path.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def features(host: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of both parts, each part's own, as a unit vector."""
    seen: dict[int, float] = {}
    for mark, part in ((b"h", f".{host}."), (b"p", f"{path}$")):
        raw = part.encode("utf-8", "surrogatepass")
        for n in SIZES:
            for i in range(len(raw) - n + 1):
                at = zlib.crc32(mark + raw[i:i + n]) % WIDTH
                seen[at] = seen.get(at, 0.0) + 1.0
    columns = np.fromiter(seen, np.int64, len(seen))
    values = np.fromiter(seen.values(), np.float64, len(seen))
    return columns, values / max(1.0, float(np.sqrt((values ** 2).sum())))


def invented_name(number: int) -> str:
    """A pronounceable name of two or three syllables, as ordinary hosts often have; the number decides."""
    turn, parts = zlib.crc32(f"name {number}".encode()), []
    for _ in range(2 + number % 2):
        for of in (ONSETS, VOWELS, CODAS):
            parts.append(of[turn % len(of)])
            turn //= len(of)
    return "".join(parts)


def labelled_words() -> list[tuple[str, bool]]:
    """What the stated table is about: (word, blocked)."""
    bad = [(w, True) for words in BAD_WORDS.values() for w in words.split()]
    return bad + [(w, False) for w in (GOOD_WORDS + " " + LOOKALIKES).split()] + [(invented_name(i), False) for i in range(INVENTED)]


def labelled_urls(words: list[tuple[str, bool]] | None = None, domains: tuple[str, ...] = DOMAINS) -> list[tuple[str, str, bool]]:
    """The stated table (host, path, blocked): hosts of bad and of ordinary words, alone or with another word or an invented name.

    Domain, prefix, path and the other word are dealt alike to both verdicts. No part of it is taken from pages to be judged.
    """
    rows = []
    for word, blocked in labelled_words() if words is None else words:
        common = COMMON_WORDS.split()
        for i in range(16 if blocked else 5):
            turn = zlib.crc32(f"{word}/{i}".encode())
            other = common[turn // 3 % len(common)] if turn % 3 else invented_name(INVENTED + turn % 1000)
            name = (f"{word}-{other}", f"{other}-{word}", f"{other}{word}", f"{word}{other}", word)[i % 5]
            host = f"{PREFIXES[turn // 5 % 4]}{name}.{domains[turn // 20 % len(domains)]}"
            rows.append((host, f"/{LANGUAGES[turn // 64 % 4]}/{turn // 256 % 10000}{('', '/', '.html')[turn // 7 % 3]}", blocked))
    return rows


def fit(labelled: DataFrame, sample: int = SAMPLE, share: float = SHARE) -> tuple[np.ndarray, float]:
    """Weights of the model, from at most ``sample`` rows of each verdict (the first by hash), weighted as if ``share`` were blocked."""
    rows = []
    for blocked in (True, False):
        part = labelled.where(F.col("blocked") == blocked).select("host", "path", "blocked")
        rows += part.orderBy(F.xxhash64("host", "path"), "host", "path").limit(sample).collect()
    if not rows:
        return np.zeros(WIDTH), -1.0
    x = Sparse([features(r.host or "", r.path or "") for r in rows], WIDTH)
    y = np.array([float(r.blocked) for r in rows])
    weights = np.where(y > 0, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum()))
    return fit_logistic(x, y, weights, l2=1e-4, rounds=300)


def with_score(df: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """Adds ``score``, the probability of block, to rows with ``host`` and ``path``; one pass, no shuffle."""
    weights, intercept = model

    def run(batches):
        for batch in batches:
            parts = [features(h or "", p or "") for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            scores = sigmoid(Sparse(parts, WIDTH).dot(weights) + intercept)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "score"])

    return df.mapInArrow(run, f"{', '.join(f'{n} {t}' for n, t in df.dtypes)}, score double")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame | None = None, id_column: str = "page_id",
          url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score: the longest fitting rule's verdict, else block where score >= 0.5."""
    if labelled is None:
        labelled = pages.sparkSession.createDataFrame(labelled_urls(), "host string, path string, blocked boolean")
    model = fit(labelled)
    host, path = split_url(F.col(url))
    rows = with_score(pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path")), model)
    rule = longest_rule(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule["rule"].alias("rule"),
                       F.coalesce(rule["verdict"], by_model).alias("verdict"), "score")
