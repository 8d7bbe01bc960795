"""Text, number and JSON expressions. All of them are plain Catalyst expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

from parcelflow.functions.let import bind
from parcelflow.schemas import JOB_LOGS

# Patterns that decide which texts are lots, areas and blocks.
LOT_LABEL = r"(?i)\bL\s*\d{1,3}[A-Z]?"
AREA_TEXT = r"(?i)\d+(?:[,.]\d+)?\s*m(?:²|2|Â²)"
NON_LOT_AREA = r"(?i)(?:\bA\s*\.?\s*V\s*\.?\s*\d|\bOPUB\s*\d*|\bAPP\b)"
SYNTHETIC_NAME = r"(?i)^Lote\s+\d+$"
BLOCK_PREFIXED = r"^(Q(?:D|U(?:ADRA)?)?|E)[\s.\-]*(\d{1,4}[A-Z]?)$"
BLOCK_BARE = r"^\d{1,4}[A-Z]?$"
DECLARED_LOTS = r"(?i)([A-Z]{1,6}[\s.\-]*\d{1,4}[A-Z]?)\s*[-–—]\s*(\d{1,4})\s*LOTES"
DECLARED_GROUP = r"(?i)([A-ZÀ-Ú][A-ZÀ-Ú \.]{3,40}?)\s*[-–—]?\s*(\d{2,4})\s*LOTES"
DECLARED_BLOCK_NAME = r"(?i)^[A-Z]{1,3}\d{1,4}[A-Z]?\s*[-–—]\s*\d{1,4}\s*LOTES"

# Style limits and their defaults.
OPACITY_RANGE = (0.20, 1.0, 0.70)
STROKE_RANGE = (0.20, 2.5, 0.60)
LABEL_MODES = ("auto", "always", "hidden")
QUALITY_PRESETS = ("light", "optimized", "balanced", "normal", "sharp", "high")


def _fold_table() -> tuple[str, str]:
    source, target = [], []
    for code in range(0xA0, 0x250):
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode("ascii")
        if len(plain) == 1:
            source.append(chr(code))
            target.append(plain)
    return "".join(source), "".join(target)


_FOLD_FROM, _FOLD_TO = _fold_table()


def fold_ascii(text: Column) -> Column:
    """Accents folded to ASCII, other non-ASCII characters dropped."""
    return F.regexp_replace(F.translate(text, _FOLD_FROM, _FOLD_TO), r"[^\x00-\x7F]", "")


def clean_text(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), r"\s+", " ")


def is_non_lot_area(text: Column) -> Column:
    return fold_ascii(F.coalesce(text, F.lit(""))).rlike(NON_LOT_AREA)


def lot_label(text: Column) -> Column:
    """First lot label, upper case without spaces, or an empty string."""
    return F.upper(F.regexp_replace(F.regexp_extract(F.coalesce(text, F.lit("")), LOT_LABEL, 0), r"\s+", ""))


def area_text(text: Column) -> Column:
    """First printed area after the lot label (or anywhere when there is no label)."""
    value = F.coalesce(text, F.lit(""))
    after = F.regexp_extract(value, r"(?s)" + LOT_LABEL + r"(.*)$", 1)
    searched = F.when(value.rlike(LOT_LABEL), after).otherwise(value)
    return F.replace(F.replace(F.regexp_extract(searched, AREA_TEXT, 0), F.lit(" "), F.lit("")), F.lit("Â²"), F.lit("²"))


def normalize_block(text: Column) -> Column:
    """``QD-14`` → ``Q14``, ``E12`` → ``E12``, ``14`` → ``Q14``, anything else → empty."""
    value = F.upper(F.regexp_replace(clean_text(text), r"\s+", ""))
    prefix = F.regexp_extract(value, BLOCK_PREFIXED, 1)
    return (
        F.when(prefix != "", F.concat(F.substring(prefix, 1, 1), F.regexp_extract(value, BLOCK_PREFIXED, 2)))
        .when(value.rlike(BLOCK_BARE), F.concat(F.lit("Q"), value))
        .otherwise("")
    )


def lot_number(name: Column) -> Column:
    digits = F.regexp_extract(F.coalesce(name, F.lit("")), r"\d+", 0)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0))


def parse_area_simple(text: Column) -> Column:
    """First number with at most one separator, read as a decimal point: ``1.234,56`` is 1.234."""
    digits = F.regexp_extract(F.coalesce(text, F.lit("")), r"\d+(?:[.,]\d+)?", 0)
    value = F.replace(digits, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(value > 0, value)


def _area_body(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"-?\d[\d.,]*", 0)


def _decimals(body: Column) -> Column:
    """Digits after the decimal separator of ``body``, 0 when it has none.

    With both separators the last one is decimal; a single kind followed by exactly three
    characters, and with something before it, groups thousands.
    """
    def judge(tail: Column) -> Column:
        both = body.contains(".") & body.contains(",")
        grouping = (tail == 3) & (F.length(body) > 4) & ~both
        return F.when(grouping, 0).otherwise(tail)

    # Length of what follows the last separator; the whole text has none when nothing is cut off.
    tail = F.length(F.regexp_extract(body, r"[.,]([^.,]*)$", 1))
    return bind(tail, judge)


def parse_area_locale(text: Column) -> Column:
    def number(body: Column) -> Column:
        digits = F.regexp_replace(body, r"[.,]", "").try_cast("double")
        return digits / F.pow(F.lit(10.0), _decimals(body))

    return bind(_area_body(text), number)


def fixed(value: Column, decimals: int) -> Column:
    """Number text with ``decimals`` digits and no grouping."""
    return F.replace(F.format_number(value, decimals), F.lit(","), F.lit(""))


def format_area_like(shape_text: Column, value: Column) -> Column:
    """``value`` written in the decimals, separator, prefix and suffix of ``shape_text``."""
    raw = F.coalesce(shape_text, F.lit(""))

    return F.when(_area_body(raw) == "", "").otherwise(bind(_area_body(raw), lambda body: _rewrite(raw, body, value)))


def _rewrite(raw: Column, body: Column, value: Column) -> Column:
    def with_decimals(d: Column) -> Column:
        # format_number takes a pattern column only in SQL, hence the expression text.
        number = F.call_function("format_number", value, F.concat(
            F.lit("0"), F.when(d > 0, F.concat(F.lit("."), F.repeat(F.lit("0"), d))).otherwise("")))
        mark = F.when(d > 0, F.substr(body, F.length(body) - d, F.lit(1))).otherwise(",")
        return F.concat(F.substr(raw, F.lit(1), F.instr(raw, body) - 1), F.replace(number, F.lit("."), mark),
                        F.substr(raw, F.instr(raw, body) + F.length(body)))

    return bind(_decimals(body), with_decimals)


def format_br(value: Column, decimals: int | None = None) -> Column:
    """``1.234,56``; without ``decimals`` the digits follow the magnitude."""
    size = F.abs(value)
    if decimals is None:
        text = F.when(size >= 100, F.format_number(size, 0)).when(size >= 1, F.format_number(size, 1)).otherwise(
            F.format_number(size, 2))
    else:
        text = F.format_number(size, max(0, min(6, decimals)))
    sign = F.when(value < 0, "-").otherwise("")
    finite = value.isNotNull() & ~F.isnan(value) & (size < float("inf"))
    return F.when(finite, F.concat(sign, F.translate(text, ",.", ".,"))).otherwise("-")


def pad_digits(text: Column, width: Column) -> Column:
    """Left zero padding that never cuts a longer number."""
    return F.concat(F.repeat(F.lit("0"), F.greatest(width - F.length(text), F.lit(0))), text)


def next_name(name: Column, step: Column) -> Column:
    """The last digit run moved on by ``step``, zero padding kept; a name without digits gets a number."""
    text = F.coalesce(name, F.lit(""))
    parts = r"(?s)^(.*?)(\d+)(\D*)$"

    def bump(digits: Column) -> Column:
        value = digits.try_cast("bigint") + step
        moved = F.concat(
            F.regexp_extract(text, parts, 1), F.when(value < 0, "-").otherwise(""),
            pad_digits(F.abs(value).cast("string"), F.length(digits)), F.regexp_extract(text, parts, 3))
        return F.when(digits == "", F.concat(text, F.lit(" "), (step + 1).cast("string"))).otherwise(moved)

    return bind(F.regexp_extract(text, parts, 2), bump)


def name_from_pattern(pattern: str, value: Column, pad: int, block: Column, status_label: Column) -> Column:
    """``{n}`` padded counter, ``{q}`` block, ``{s}`` status label."""
    width = F.lit(max(0, min(8, pad)))
    number = F.concat(F.when(value < 0, "-").otherwise(""), pad_digits(F.abs(value).cast("string"), width))
    text = F.replace(F.lit(pattern), F.lit("{n}"), number)
    text = F.replace(text, F.lit("{q}"), F.coalesce(block, F.lit("")))
    return F.replace(text, F.lit("{s}"), F.coalesce(status_label, F.lit("")))


def name_search_regex(text: str | None) -> str | None:
    """Java regex for a user's name search: ``/re/``, ``*``/``?`` globs (anchored) or a substring."""
    raw = (text or "").strip()
    if not raw:
        return None
    if len(raw) > 2 and raw.startswith("/") and raw.rindex("/") > 0:
        end = raw.rindex("/")
        flags = {"i"} | (set(raw[end + 1:]) & set("ms"))
        return f"(?{''.join(sorted(flags))}){raw[1:end]}"
    globbed = "*" in raw or "?" in raw
    body = "".join(r"[\s\S]*" if c == "*" else r"[\s\S]" if c == "?" else (c if c.isalnum() or c == " " else "\\" + c)
                   if ord(c) < 128 else c for c in raw)
    return f"(?iu)^{body}$" if globbed else f"(?iu){body}"


def clamp_number(value: Column, low: float, high: float, default: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value.try_cast("double"), F.lit(default))))


def clamp_opacity(value: Column) -> Column:
    return clamp_number(value, *OPACITY_RANGE)


def clamp_stroke(value: Column) -> Column:
    return clamp_number(value, *STROKE_RANGE)


def label_mode(value: Column) -> Column:
    mode = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(mode.isin(*LABEL_MODES), mode).otherwise(LABEL_MODES[0])


def quality_preset(value: Column) -> Column:
    key = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(key.isin(*QUALITY_PRESETS), key).otherwise("balanced")


def json_logs(text: Column) -> Column:
    """Job log array; null, malformed or non-array text reads as an empty array."""
    usable = F.try_parse_json(text).isNotNull() & F.ltrim(text).startswith("[")
    empty = F.from_json(F.lit("[]"), JOB_LOGS)
    return F.coalesce(F.when(usable, F.from_json(text, JOB_LOGS)), empty)


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def normalize_email(email: Column) -> Column:
    return F.lower(F.trim(email))


def slug_base(name: Column, max_length: int = 64) -> Column:
    """URL identifier; null when fewer than three characters remain."""
    slug = F.regexp_replace(F.lower(fold_ascii(name)), r"[^a-z0-9]+", "-")
    slug = F.regexp_replace(slug, r"^-+|-+$", "")
    return F.when(F.length(slug) >= 3, F.substring(slug, 1, max_length))


def hmac_sha256(key_hex: Column, message: Column) -> Column:
    """HMAC-SHA256 as hex, for a key given as hex text; a key of more than 64 bytes is hashed first."""
    key = bind(key_hex, lambda k: F.when(F.length(k) > 128, F.sha2(F.unhex(k), 256)).otherwise(k))
    words = bind(F.rpad(key, 128, "0"), lambda block: F.transform(
        F.sequence(F.lit(1), F.lit(121), F.lit(8)), lambda i: F.conv(F.substr(block, i, F.lit(8)), 16, 10).cast("bigint")))

    def signed(words: Column) -> Column:
        mask = lambda byte: F.unhex(F.array_join(F.transform(words, lambda w: F.lpad(F.hex(w.bitwiseXOR(F.lit(byte * 0x01010101))), 8, "0")), ""))
        return F.sha2(F.concat(mask(0x5C), F.unhex(F.sha2(F.concat(mask(0x36), F.encode(message, "UTF-8")), 256))), 256)

    return bind(words, signed)


_IPV4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"

# IPv4 ranges that are not publicly routable, as (first, last) dotted text.
RESERVED_IPV4 = (
    ("0.0.0.0", "0.255.255.255"),
    ("10.0.0.0", "10.255.255.255"),
    ("100.64.0.0", "100.127.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.255"),
    ("192.0.2.0", "192.0.2.255"),
    ("192.88.99.0", "192.88.99.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"),
    ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"),
    ("224.0.0.0", "255.255.255.255"),
)


def _ipv4_number(text: str) -> int:
    a, b, c, d = (int(part) for part in text.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def _public_ipv4(host: Column) -> Column:
    octet = lambda i: F.regexp_extract(host, _IPV4, i).try_cast("bigint")

    def outside(number: Column) -> Column:
        ranges = [number.between(_ipv4_number(first), _ipv4_number(last)) for first, last in RESERVED_IPV4]
        return ~F.coalesce(F.array_contains(F.array(*ranges), True), F.lit(True))

    number = ((octet(1) * 256 + octet(2)) * 256 + octet(3)) * 256 + octet(4)
    wellformed = F.greatest(octet(1), octet(2), octet(3), octet(4)) <= 255
    return ~host.rlike(_IPV4) | ~wellformed | bind(number, outside)


def url_allowed(url: Column) -> Column:
    """HTTPS on port 443, a host, no credentials, fragment, control character or backslash, and no
    literal address outside the public ranges (IPv6: only global unicast 2000::/3)."""
    clean = ~url.rlike(r"[\x00-\x20\x7F\\#]")

    def judge(authority: Column) -> Column:
        host = F.lower(F.regexp_extract(authority, r"^([^:@\[\]]+)(?::(?:443)?)?$", 1))
        host_v6 = F.lower(F.regexp_extract(authority, r"^\[([0-9A-Fa-f:.]+)\](?::(?:443)?)?$", 1))
        reserved_v6 = r"^2001:(0?db8|0{0,3}:|0{0,2}[0-9a-f]{1,2}:)|^2002:|^3fff:"
        public_v6 = host_v6.rlike(r"^[23][0-9a-f]{3}:") & ~host_v6.rlike(reserved_v6)
        return bind(host, lambda h: (h != "") & _public_ipv4(h)) | public_v6

    return F.coalesce(clean & bind(F.regexp_extract(url, r"^(?i:https)://([^/?]*)", 1), judge), F.lit(False))
