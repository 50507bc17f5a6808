"""Detection of sensitive values as one Column expression: find, validate, unite, order, resolve overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import patterns as P
from veilframe.functions import validators as V
from veilframe.functions.offsets import MATCHES, find_all, in_blocks, no_matches
from veilframe.functions.validators import is_placeholder, let
from veilframe.kinds import BY_NAME, KINDS, Settings

#: A text that fails its detector's filter has no match; these are far cheaper than the patterns.
_SPECIAL = "[" + "".join("\\" + c for c in P.CREDENTIAL_SPECIALS) + "]"
_RUN = r"""[^\s:=,;|"'<>]"""
_NEITHER, _PLAIN, _UNDIGITAL = (rf"""[^\s:=,;|"'<>{x}]*+""" for x in ("0-9" + _SPECIAL[1:-1], _SPECIAL[1:-1], "0-9"))
_WORTH = {
    # From the start of a run to its first digit or special character, and on to the first of the other sort.
    "credential": lambda t: t.rlike("[0-9]") & t.rlike(_SPECIAL) & t.rlike(f"(?<!{_RUN}){_NEITHER}(?:[0-9]{_PLAIN}{_SPECIAL}|{_SPECIAL}{_UNDIGITAL}[0-9])"),
    "email": lambda t: F.contains(t, F.lit("@")),
    "iban": lambda t: F.contains(t, F.lit("TR")),
    "credit_card": lambda t: t.rlike(r"(?U)\d[ \-]?\d[ \-]?\d[ \-]?\d"),
    "national_id": lambda t: t.rlike(r"(?U)\d{11}"),
    "phone": lambda t: t.rlike(r"(?U)[2-5]\d{2}\)?[ \-]?\d{3}"),
    "phone_international": lambda t: t.rlike(r"(?U)\+\d"),
    "labelled_password": lambda t: t.rlike(r"[:=\-]"),
}
#: The credential pattern takes whole runs, and a run that fails consumes nothing else; so what makes a run acceptable
#: can be asked before it is taken, which spares a list of all long words.
_CREDENTIAL = rf"(?U)(?={_RUN})(?<!{_RUN})(?={_RUN}*?[0-9])(?={_RUN}*?{_SPECIAL}){_RUN}{{6,}}+"


def candidates(text: Column, detector: P.Detector) -> Column:
    """Accepted matches of one detector, before overlaps are resolved."""
    pattern, group = {"credential": (_CREDENTIAL, 0), "email": (V.EMAIL_FROM_RUN, 1)}.get(detector.name, (detector.java(), detector.group))
    valid, isolated = V.VALID.get(detector.name), detector.name in V.ISOLATED

    def keep(x: Column) -> Column:
        ok = F.length(x["value"]) > 0
        ok = ok & valid(x["value"]) if valid else ok
        return ok & ~x["before"].rlike("[0-9]") & ~x["after"].rlike("[0-9]") if isolated else ok

    found = find_all(text, pattern, BY_NAME[detector.kind].order, keep, group, isolated)
    worth = _WORTH.get(detector.name)
    return F.when(worth(text), found).otherwise(no_matches()) if worth else found


def resolve_overlaps(matches: Column) -> Column:
    """Of matches in any order those that stay: earliest first, the longer on equal starts, then by kind; none overlaps one before it."""
    end = lambda m: m["start"] - m["neg_length"]
    step = lambda a, m: F.when(m["start"] < a["end"], a).otherwise(F.struct(end(m).alias("end"), F.concat(a["out"], F.array(m)).alias("out")))

    def block(done: Column, these: Column) -> Column:
        kept = F.aggregate(these, F.struct(done["end"].alias("end"), no_matches().alias("out")), step)
        return let(kept, lambda k: F.struct(k["end"].alias("end"), F.concat(done["out"], F.array(k["out"])).alias("out")))

    zero = F.struct(F.lit(0).alias("end"), F.array().cast(f"array<{MATCHES}>").alias("out"))
    kept = lambda found: F.flatten(F.aggregate(in_blocks(found, lambda x: x), zero, block)["out"])
    return let(F.array_sort(matches), lambda found: F.when(F.size(found) < 2, found).otherwise(kept(found)))


def detect(text: Column, settings: Settings | None = None) -> Column:
    """Matches of a text in order, as array<struct<start, neg_length, kind_ord, value>>; null for a null text."""
    found = [candidates(text, d) for d in P.detectors(settings or Settings())]
    if not found:
        return F.when(text.isNotNull(), no_matches())
    every = F.filter(F.concat(*found) if len(found) > 1 else found[0], lambda m: ~is_placeholder(m["value"]))
    return F.when(text.isNotNull(), resolve_overlaps(every))


def kind_name(kind_ord: Column) -> Column:
    return F.get(F.array(*[F.lit(k.name) for k in KINDS]), kind_ord)


def kind_prefix(kind_ord: Column) -> Column:
    return F.get(F.array(*[F.lit(k.prefix) for k in KINDS]), kind_ord)


def matches(df: DataFrame, text_col: str, keys: list[str], settings: Settings | None = None) -> DataFrame:
    """One row per match: keys, pos, start, end, kind, value."""
    found = df.select(*keys, F.posexplode(detect(F.col(text_col), settings)).alias("pos", "m"))
    return found.select(*keys, "pos", F.col("m.start").alias("start"), (F.col("m.start") - F.col("m.neg_length")).alias("end"), kind_name(F.col("m.kind_ord")).alias("kind"), F.col("m.value").alias("value"))
