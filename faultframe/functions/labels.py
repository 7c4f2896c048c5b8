"""Column expressions for flight labels, class codes and reproducible hashing."""

from pyspark.sql import Column, functions as F

# Fault codes of the recordings and their names.
FAULT_NAMES = {0: "none", 1: "crack", 2: "edge_cut", 3: "surface_cut"}
# Pattern of a labelled file name.
FILE_PATTERN = r"F(\d+)_SV(\d+)_SP(\d+)_t(\d+)"
# Drone identifiers in order of precedence.
DRONE_IDS = ("D1", "D2", "D3")


def _named(code: Column, default: Column) -> Column:
    named = None
    for key, name in FAULT_NAMES.items():
        named = F.when(code == key, F.lit(name)) if named is None else named.when(code == key, F.lit(name))
    return named.otherwise(default)


def fault_name(code: Column) -> Column:
    """Name of an ingested fault code."""
    return _named(code, F.lit("other"))


def decoded_fault_name(code: Column) -> Column:
    """Name of a predicted code of any type; codes outside the dictionary stay visible."""
    text = code.cast("string")
    number = text.try_cast("int")
    return F.when(number.isNull(), F.concat(F.lit("Invalid ("), text, F.lit(")"))).otherwise(
        _named(number, F.concat(F.lit("Unknown ("), text, F.lit(")")))
    )


def drone_id(file_name: Column) -> Column:
    found = F.lit("Unknown")
    for drone in reversed(DRONE_IDS):
        found = F.when(file_name.contains(drone), F.lit(drone)).otherwise(found)
    return found


def file_labels(file_name: Column) -> dict[str, Column]:
    """Label columns read from a file name; a name without the pattern means a healthy flight."""
    matched = file_name.rlike(FILE_PATTERN)

    def part(group: int) -> Column:
        return F.when(matched, F.regexp_extract(file_name, FILE_PATTERN, group).try_cast("int")).otherwise(F.lit(0))

    code = part(1)
    healthy = F.when(code == 0, F.lit(1)).otherwise(F.lit(0))
    return {
        "healthy": healthy,
        "fault_type": fault_name(code),
        "severity": F.when(healthy == 1, F.lit(0)).otherwise(part(2)),
        "trajectory": part(4),
        "drone_id": drone_id(file_name),
        "speed_case": part(3),
    }


def binary_fault(healthy: Column) -> Column:
    return F.when(healthy == 1, F.lit(0)).otherwise(F.lit(1))


def encode_combined(fault: Column, kind: Column, severity: Column) -> Column:
    return (fault * 100 + kind * 10 + severity).cast("int")


def decode_combined(code: Column) -> dict[str, Column]:
    return {
        "fault": F.floor(code / 100).cast("int"),
        "type": (F.floor(code / 10) % 10).cast("int"),
        "sev": (code % 10).cast("int"),
    }


def hash_key(seed: int, *columns) -> Column:
    """Reproducible text hash of a row identity, equal on every run and partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def hash_bucket(key: Column) -> Column:
    """First four hex digits of a hash as 0..65535; keeps the order of the text."""
    return F.conv(F.substring(key, 1, 4), 16, 10).cast("long")
