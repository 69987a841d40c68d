"""Text normalisation and compact keys for long values, as SQL text."""

from __future__ import annotations

# The characters Unicode-aware whitespace stripping removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# A value of more bytes than this travels through shuffles as its SHA-256 digest.
LONG_BYTES = 128


# Marks a digest. Plain values that begin with the mark are digested as well,
# so a key always tells which of the two it is.
MARK = "sha256:"


def normalise(value: str) -> str:
    """Strip surrounding whitespace and lower-case: the spelling-group key."""
    chars = "".join(f"\\u{ord(c):04x}" for c in WHITESPACE)
    return f"lower(btrim({value}, '{chars}'))"


def is_digested(value: str) -> str:
    return f"(octet_length({value}) > {LONG_BYTES} OR startswith({value}, '{MARK}'))"


def compact(value: str) -> str:
    """The value itself, or the marked digest of the whole value when it is long."""
    digest = f"concat('{MARK}', sha2(cast({value} AS binary), 256))"
    return f"CASE WHEN {is_digested(value)} THEN {digest} ELSE {value} END"
