"""Secret names, masking of secrets in text and nested values, placeholder answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "***"
# Words and word pairs that name a secret, and words of quantities, which never do.
SECRET_WORDS = [
    "password", "passwd", "pwd", "pass", "passphrase", "secret", "token", "authorization", "auth", "cookie", "cookies", "session", "jwt", "otp",
    "dsn", "credential", "credentials", "sig", "signature", "apikey", "privatekey", "accesskey", "signingkey", "encryptionkey", "masterkey", "connectionstring",
]
SECRET_PAIRS = ["api key", "access key", "private key", "client secret", "signing key", "encryption key", "master key", "connection string"]
SECRET_ENDINGS = "(token|secret|password|passwd|apikey|signature)$"
QUANTITIES = ["count", "counts", "total", "length", "len", "size", "limit", "max", "min"]

# Fixed value: where a name's words begin and end.
_WORD = r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+"


def is_secret_key(key: Column) -> Column:
    """A name is judged by its words, never by a substring: ``apiKey`` and ``DB_PASSWORD`` are secrets, ``design``,
    ``passCount`` and ``dedupeKey`` are not."""
    words = F.transform(F.regexp_extract_all(F.substring(key, 1, 200), F.lit(_WORD), F.lit(0)), F.lower)
    return F.coalesce(_once(words, _names_secret), F.lit(False))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that it reads several times: a list of one binds the value, so that it is worked out once."""
    return F.transform(F.array(value), use)[0]


def _names_secret(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(2), F.greatest(F.size(words), F.lit(2))), lambda i: F.concat_ws(" ", F.try_element_at(words, i - 1), F.try_element_at(words, i)))
    quantity = (F.size(words) > 1) & F.try_element_at(words, F.lit(-1)).isin(QUANTITIES)
    named = F.arrays_overlap(words, F.array(*map(F.lit, SECRET_WORDS))) | F.arrays_overlap(pairs, F.array(*map(F.lit, SECRET_PAIRS)))
    return ~quantity & (named | F.array_join(words, "").rlike(SECRET_ENDINGS))


_NAME = r"[A-Za-z_][\w.-]*"
_SIGN = r"\s*(?:=|:|%3[DdAa])\s*"
#: What stands behind a name: quoted, a list, or up to the next mark; a mask, or a scheme whose token is masked already, stays.
_QUOTED = r'"(?:[^"\\]|\\.)*"'
_VALUE = r"(?!\*\*\*|(?:bearer|basic)\b)(?:'[^']*'|\[[^\]]*\]|[^\s&\"',;}\])<>]+)"


_SCHEME = r"[a-z][a-z0-9+.-]{0,30}"
_HEADERS = r"((?:proxy-)?authorization|(?:set-)?cookie|x-api-key|api-key)(\s*+:\s*+)"
#: Applied in this order: a line of query parameters; user information in addresses, also with marks in its password, percent-
#: encoded, or without a scheme before a host and port; tokens; the rest of a header's line; a bare ``key`` parameter.
_RULES = [
    (r"(?m)^([ \t]*params:)[^\n]*", f"$1 {MASK}"),
    (rf"(?i)\b({_SCHEME}://)[^\s/?#]*@", f"$1{MASK}@"),
    (rf"(?i)\b({_SCHEME}://)[^\s/?#@:]{{0,256}}:(?!\d{{1,5}}[/?#])[^\s@]{{0,256}}@", f"$1{MASK}@"),
    (rf"(?i)\b({_SCHEME}%3A%2F%2F)(?:(?!%2F|%3F|%23)[^\s&/?#]){{0,512}}%40", f"$1{MASK}%40"),
    (r"(?<=^|[\s\"'=(,;<\[{])[^\s:@/\"'=]{1,64}:[^\s/]{1,256}@(?=[\w.-]{1,253}:\d{1,5}\b)", f"{MASK}@"),
    (r"(?i)\b(bearer)\s+\S+", f"$1 {MASK}"),
    (r"\b([Bb]asic)\s+\S{6,}", f"$1 {MASK}"),
    (rf"(?i)\b{_HEADERS}(bearer|basic)\s[^\r\n]{{0,4096}}", f"$1$2$3 {MASK}"),
    (rf"(?i)\b{_HEADERS}(?!(?:bearer|basic)\s)[^\r\n]{{1,4096}}", f"$1$2{MASK}"),
    (r"(?i)([?&;]key)=[^\s&\"',;]+", f"$1={MASK}"),
]


def redact_text(text: Column, longest: int = 10_000) -> Column:
    """Masks user information in addresses (also percent-encoded, or before a bare host and port), tokens, the lines of headers
    that carry secrets, and the value of every name that ``is_secret_key`` calls a secret (``name=value``, ``name: value``,
    JSON); then cuts to ``longest``."""
    masked = text
    for pattern, mask in _RULES:
        masked = F.regexp_replace(masked, pattern, mask)
    return _once(masked, lambda m: _cut(_mask_named(m), longest))


def _mask_named(masked: Column) -> Column:
    # the names that stand before a sign are judged one by one; a pattern of the secret ones masks their values
    named = F.array_distinct(F.regexp_extract_all(masked, F.lit(rf"(?<![\w.-])({_NAME})[\"']?{_SIGN}"), F.lit(1)))
    secret = F.array_join(F.transform(F.filter(named, is_secret_key), lambda n: F.replace(n, F.lit("."), F.lit("\\."))), "|")

    def mask(names: Column) -> Column:
        head = F.concat(F.lit(r"(?<![\w.-])([\"']?(?:"), names, F.lit(rf")[\"']?{_SIGN})"))
        quoted = F.regexp_replace(masked, F.concat(head, F.lit(_QUOTED)), F.lit(f'$1"{MASK}"'))
        plain = F.regexp_replace(quoted, F.concat(F.lit("(?i)"), head, F.lit(_VALUE)), F.lit(f"$1{MASK}"))
        return F.when(names != "", plain).otherwise(masked)

    return _once(secret, mask)


def _cut(masked: Column, longest: int) -> Column:
    return _once(masked, lambda m: F.when(F.length(m) > longest, F.concat(F.substring(m, 1, longest), F.lit("…"))).otherwise(m))


def redact_map(values: Column) -> Column:
    """Values of secret keys are masked, other values redacted as text."""
    return F.transform_values(values, lambda k, v: F.when(is_secret_key(k), F.lit(MASK)).otherwise(redact_text(v)))


def is_placeholder(value: Column) -> Column:
    """Answers that say there is none: dashes, n/a, none, unknown, not found."""
    return F.coalesce(F.trim(value).rlike(r"(?i)^(-+|n/?a|none|null|undefined|unknown|<unknown>|not\s+(found|available|specified|listed|provided))$"), F.lit(False))
