"""Signed requests by built-in functions: percent-encoding, HMAC-SHA256 (RFC 2104), strings to sign.

A key is a literal of the plan, so it shows where plans are logged. Defined results: a null value of a
parameter leaves the parameter out; a null message has a null signature.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a block of SHA-256.
BLOCK = 64


def percent_encoded(c: Column) -> Column:
    """All but letters, digits and - _ . ~ as the bytes of their UTF-8, %XX; a space is %20."""
    out = F.url_encode(c)
    for given, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(given), F.lit(wanted))
    return out


def hmac_sha256(key: str, message: Column) -> Column:
    """The 32 bytes that sign a text with a key."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > BLOCK else raw).ljust(BLOCK, b"\0")
    padded = lambda mask, rest: F.unhex(F.sha2(F.concat(F.lit(bytes(b ^ mask for b in raw)), rest), 256))
    return padded(0x5C, padded(0x36, message.cast("binary")))


def sorted_query(params: Column) -> Column:
    """A map of parameters as name=value, sorted by name, joined by &."""
    given = F.map_filter(params, lambda k, v: v.isNotNull())
    return F.array_join(F.transform(F.array_sort(F.map_entries(given)), lambda x: F.concat(x["key"], F.lit("="), percent_encoded(x["value"]))), "&")


def to_sign(method: str, url: Column, query: Column) -> Column:
    """Method, host, path and query on a line each."""
    return F.concat_ws("\n", F.lit(method), F.parse_url(url, F.lit("HOST")), F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), query)


# Names of the parameters that a signature of version 2 and of 2.1 adds.
ADDED = {"2": ("AccessKeyId", "SignatureVersion", "SignatureMethod", "Timestamp", "Signature"), "2.1": ("accessKey", "signatureVersion", "signatureMethod", "timestamp", "signature")}


def signed_query(method: str, url: Column, params: Column, at: Column, access_key: str, secret: str, version: str = "2") -> Column:
    """The query string of a request at a time (UTC, to the second) with its signature, in base64, as the last
    parameter. An empty key is an error."""
    if not access_key or not secret:
        raise ValueError("an access key and a secret are needed")
    *names, signature = ADDED[version]
    values = (F.lit(access_key), F.lit(version), F.lit("HmacSHA256"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))
    query = sorted_query(F.map_concat(params, F.create_map(*[x for n, v in zip(names, values, strict=True) for x in (F.lit(n), v)])))
    return F.concat(query, F.lit(f"&{signature}="), percent_encoded(F.base64(hmac_sha256(secret, to_sign(method, url, query)))))


def hex_signature(method: str, url: Column, params: Column, secret: str) -> Column:
    """The older form: the signature in upper-case hexadecimals."""
    return F.hex(hmac_sha256(secret, to_sign(method, url, sorted_query(params))))
