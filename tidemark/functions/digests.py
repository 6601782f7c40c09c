"""Digests of operations, operation sets and states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ZERO_DIGEST
from .paths import sort_key


def op_id(peer: Column, uuid: Column, at_ms: Column, type_: Column, path: Column, hash_: Column) -> Column:
    facts = [F.coalesce(c.cast("string"), F.lit("")) for c in (peer, uuid, at_ms, type_, path, hash_)]
    return F.sha2(F.concat_ws("|", *facts), 256)


def xor_digest(op: Column) -> Column:
    """An aggregate: the XOR of all 64-digit hex ids, in eight 32-bit parts that combine map-side; zeros for none."""
    part = lambda i: F.bit_xor(F.conv(F.substring(op, 1 + 8 * i, 8), 16, 10).cast("bigint"))
    digits = F.concat(*(F.lpad(F.lower(F.hex(F.coalesce(part(i), F.lit(0).cast("bigint")))), 8, "0") for i in range(8)))
    return F.coalesce(digits, F.lit(ZERO_DIGEST))


def xor_hex(left: Column, right: Column) -> Column:
    """Digit by digit XOR of two 64-digit hex texts; what is missing or no hex digit counts as 0."""

    def part(x: Column, i: int) -> Column:
        clean = F.regexp_replace(F.rpad(F.lower(F.coalesce(x, F.lit(""))), 64, "0"), "[^0-9a-f]", "0")
        return F.conv(F.substring(clean, 1 + 8 * i, 8), 16, 10).cast("bigint")

    return F.concat(*(F.lpad(F.lower(F.hex(part(left, i).bitwiseXOR(part(right, i)))), 8, "0") for i in range(8)))


def lower_escapes(json: Column) -> Column:
    """JSON with its escapes of control characters in small letters; a backslash that is escaped itself begins none."""
    out = json
    for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):  # the others have no letters
        out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*)\\u{code:04X}", rf"$1\\u{code:04x}")
    return F.when(json.rlike(r"\\u00[01][A-F]"), out).otherwise(json)


def entry_json(kind: Column, path: Column, hash_: Column, size: Column, updated: Column, uuid: Column) -> Column:
    """One entry's canonical JSON: keys sorted, nulls kept."""
    return lower_escapes(F.to_json(F.struct(hash_.alias("hash"), kind.alias("kind"), path.alias("path"), size.alias("size"), updated.alias("updated"), uuid.alias("uuid")), {"ignoreNullFields": "false"}))


def state_digest(path: Column, uuid: Column, json: Column) -> Column:
    """An aggregate: SHA-256 of the JSON array of entries by path, then uuid, as UTF-16. It holds the whole state of a group at once."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(sort_key(path).alias("p"), sort_key(uuid).alias("u"), json.alias("j")))), lambda x: x["j"])
    return F.sha2(F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]")), 256)


def mergeable_digest(json: Column) -> Column:
    """An aggregate that combines map-side, for states too large for one row: the XOR of the entries' SHA-256."""
    return xor_digest(F.sha2(json, 256))

