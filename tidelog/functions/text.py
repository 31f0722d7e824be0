"""String forms of keys, files and addresses, from built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FILE = r"^([0-9]+)\.(sst|log)$"
_ADDRESS = r"^(.*):([0-9]+)$"


def key_hex(key: Column) -> Column:
    """A key as manifest text: k and its bytes in lower-case hexadecimal."""
    return F.concat(F.lit("k"), F.lower(F.hex(key.cast("binary"))))


def key_from_hex(text: Column) -> Column:
    """The bytes of a manifest key; null unless it is k and whole hexadecimal bytes."""
    return F.when(text.rlike("^k([0-9a-fA-F]{2})*$"), F.unhex(F.substr(text, F.lit(2))))


def file_name(number: Column, suffix: str) -> Column:
    return F.concat(F.when(F.length(number.cast("string")) < 6, F.lpad(number.cast("string"), 6, "0")).otherwise(number.cast("string")), F.lit(f".{suffix}"))


def file_number(name: Column) -> Column:
    """The number of a table or log file; null for other names."""
    return F.when(name.rlike(_FILE), F.regexp_extract(name, _FILE, 1).cast("long"))


def file_kind(name: Column) -> Column:
    return F.when(name.rlike(_FILE), F.regexp_extract(name, _FILE, 2))


def host(address: Column) -> Column:
    """What stands before the last colon, if the rest is a port."""
    return F.when(port(address).isNotNull(), F.regexp_extract(address, _ADDRESS, 1))


def port(address: Column) -> Column:
    """The number behind the last colon, 0 to 65535; null where there is none."""
    digits = F.regexp_extract(address, _ADDRESS, 2)
    value = F.when(address.rlike(_ADDRESS) & (F.length(digits) <= 9), digits.cast("int"))
    return F.when(value <= 65535, value)


def bench_key(n: Column) -> Column:
    return F.format_string("key%016d", n)


def test_key(n: Column) -> Column:
    return F.format_string("key%08d", n)


def op_label(code: Column) -> Column:
    """Names of operation codes."""
    return _label(code, ("get", "put", "append", "delete"))


def status_label(code: Column) -> Column:
    return _label(code, ("ok", "not_found", "wrong_leader", "wrong_partition", "timeout", "invalid"))


def role_label(code: Column) -> Column:
    return _label(code, ("follower", "candidate", "leader"))


def _label(code: Column, names: tuple[str, ...]) -> Column:
    table = F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(i), F.lit(n))))
    return F.coalesce(table[code.cast("int")], F.lit("unknown"))
