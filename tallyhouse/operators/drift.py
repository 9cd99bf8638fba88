"""Schemas that drift between files: column profiles, similarity flooding, a list of changes, one united table.

Cells are profiled by file and header in one distributed pass.  For every two successive schemas a graph is built whose
nodes are columns, the tokens of their names and their kinds; similarities of pairs of nodes flow along edges of the same
label until they settle.  What a schema lost and its successor gained is then matched one to one where the settled score,
which includes how alike the values are, is high enough.  Only per-column facts reach the matcher, never the cells.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.session import staged

#: What publishers write into a cell instead of a figure.
SUPPRESSED = (
    "supp", "ne", "na", "lowcov", "np", "new", "sp", "re", "dns", "nr", "x", "c", "z", "u", "low", ":", "~", "..", "...",
    "n/a", "n/s", "null", "none", "-", "*", "#", "!", "[z]", "[x]", "[c]", "[w]", "[u]", "redacted", "",
)
_CODES = frozenset(SUPPRESSED)

#: Default of a parameter: words that mean the same in headers of accounts and registers; each line is one meaning.  Nothing
#: outside fixes this list; what is found without it is measured in the README.
SAME_MEANING = (
    "expenditure spending spend costs cost outgoings",
    "income receipts revenue-in",
    "total all overall",
    "reserve reserves balance",
    "la authority council",
    "teacher teachers teaching",
    "staff pay salaries employees",
    "energy heat light power fuel utilities electricity gas",
    "building buildings premises upkeep maintenance repairs",
    "gift gifts donation donations voluntary",
    "letting lettings hire rent rents rental",
    "grant grants funding funds",
    "pupil pupils children learners roll",
    "name title",
    "school academy establishment",
    "trust company group",
    "number count numbers no.",
    "type kind category",
    "share apportioned portion",
    "supply return submitted",
    "not no",
    "material materials resources",
    "movement change",
    "ict it computing",
)

_STOP = frozenset("of the for in by to a an and or on at with per is if s incl including excluding y n".split())
_CODE = re.compile(r"^([a-z]{1,4})(\d{2,4})([a-z]?)$")


#: What a text must be, without currency, per cent, commas and spaces, to hold a figure.
_FIGURE = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?", re.I)
_UNITS = re.compile(r"[£$€,%\s]")
_BLANKS = re.compile(r"[\s\u00a0\u2000-\u200b\u202f\u3000\ufeff]+")


def _folded(header: str) -> str:
    return _BLANKS.sub(" ", header).strip(" ").lower()


def _constant(name: str) -> float:
    raise ValueError(f"{name} is no JSON")


def _cell(value: object) -> tuple[str | None, str | None, float | None] | None:
    """(kind, text, figure) of a JSON value; None of a JSON null; kind and text are None for codes of suppression."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean", "true" if value else "false", None
    if isinstance(value, (int, float)):
        return "number", repr(value), float(value) if abs(value) < 1e308 else None
    if isinstance(value, list):
        return "array", json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")), None
    text = value.strip(" ")
    if text.lower() in _CODES:
        return None, None, None
    plain = _UNITS.sub("", text)
    return "text", text, float(plain) if _FIGURE.fullmatch(plain) else None


def _flat(record: dict) -> dict[str, tuple]:
    """header -> (parent, kind, text, figure) of all cells of a record.

    An object inside the record gives its own cells, headed by its path (``parent.header``); an array is one cell.  Of
    headers alike when folded the first with a value counts.
    """
    out: dict[str, tuple] = {}
    todo = [("", record)]
    while todo:
        parent, obj = todo.pop()
        for key, value in obj.items():
            header = f"{parent}.{_folded(key)}" if parent else _folded(key)
            if isinstance(value, dict):
                todo.append((header, value))
                continue
            cell = _cell(value)
            if cell is not None and (header not in out or out[header][1] is None):
                out[header] = (parent, *cell)
    return out


def cells(raw: DataFrame, payload: str, by: dict[str, Column], *, entity: str | None = None, every: bool = False) -> DataFrame:
    """The cells of JSON objects, each payload parsed once: the columns of ``by``, ``header`` (folded; the path of a nested
    cell), ``parent`` (the path of the object it lies in, empty at the top), ``kind`` (number, text, boolean, array), ``text``
    and ``num``.

    ``num`` is the figure in a number or in a text that holds one (thousands commas, currency and per-cent signs aside);
    codes of suppression have neither kind nor text nor figure; JSON nulls are no cells.  Payloads that are null, cut off or
    no object give no cells.  ``entity`` names the folded header whose text is the column ``entity`` of all cells of its
    record.  With ``every`` each input row also gives one row without header, whose kind is object if it could be read.

    Parsing runs in Python, a batch at a time: nesting has no fixed depth, and the built-in parsers keep either the types of
    values or their speed.
    """
    names = list(by)
    rows = raw.select(*[c.alias(n) for n, c in by.items()], F.col(payload).cast("string").alias("_payload"))
    extra = [("entity", "string")] if entity is not None else []
    told = [*extra, ("header", "string"), ("parent", "string"), ("kind", "string"), ("text", "string"), ("num", "double")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_payload") + ", " + ", ".join(f"{n} {t}" for n, t in told)
    kinds = [pa.float64() if t == "double" else pa.string() for _, t in told]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            made: list[list] = [[] for _ in told]
            size = 0

            def out() -> pa.RecordBatch:
                index = pa.array(at, pa.int64())
                kept = [batch.column(n).take(index) for n in names]  # noqa: B023
                return pa.RecordBatch.from_arrays([*kept, *[pa.array(v, k) for v, k in zip(made, kinds)]], names=[*names, *[n for n, _ in told]])  # noqa: B023

            for i, text in enumerate(batch.column("_payload").to_pylist()):
                record = None
                try:
                    record = json.loads(text, parse_constant=_constant) if text is not None else None
                except (ValueError, RecursionError):
                    pass
                flat = _flat(record) if isinstance(record, dict) else {}
                rows = [(h, *c) for h, c in flat.items()]
                if every:
                    rows.append((None, None, "object" if isinstance(record, dict) else None, None, None))
                if entity is not None:
                    who = flat[entity][2] if entity in flat else None
                    rows = [(who, *r) for r in rows]
                at += [i] * len(rows)
                for column, values in zip(made, zip(*rows)):
                    column += values
                size += len(text or "")
                if len(at) > 200_000 or size > 16_000_000:
                    yield out()
                    at, made, size = [], [[] for _ in told], 0
            if at:
                yield out()

    return rows.mapInArrow(run, schema)


def profiles(cell_rows: DataFrame, by: list[str]) -> DataFrame:
    """Facts of each column (``by`` + header): counts by kind and moments of its figures on a signed log scale.

    All facts are sums, so profiles of parts of a file can be added up.
    """
    num, kind = F.col("num"), F.col("kind")
    log = F.signum(num) * F.log1p(F.abs(num))
    return cell_rows.groupBy(*by, "header").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(kind == "number").alias("n_number"),
        F.count_if(kind == "text").alias("n_text"),
        F.count_if(kind == "boolean").alias("n_boolean"),
        F.count_if(kind == "array").alias("n_array"),
        F.max("parent").alias("parent"),
        F.count(num).alias("n_num"),
        F.sum(log).alias("sum_log"),
        F.sum(log * log).alias("sum_log2"),
        F.count_if(num < 0).alias("n_negative"),
        F.count_if(num == F.floor(num)).alias("n_whole"),
    )


KINDS = ("number", "text", "boolean", "array")


def usual_kind() -> Column:
    """The commonest kind of a profile; the order of ``KINDS`` decides ties; null without any clear cell."""
    best = F.greatest(*[f"n_{k}" for k in KINDS])
    out = F.lit(None).cast("string")
    for k in reversed(KINDS):
        out = F.when(F.col(f"n_{k}") == best, F.lit(k)).otherwise(out)
    return F.when(best > 0, out)


# --- names -----------------------------------------------------------------------------------------------------------


def _tokens(header: str) -> tuple[list[str], set[tuple[str, str, str]]]:
    words, codes = [], set()
    for w in re.findall(r"[a-z]+\d+[a-z]?|[a-z]+|\d+|%", header.lower().replace("'", "")):
        m = _CODE.match(w)
        if m:
            codes.add(m.groups())
        elif w not in _STOP:
            words.append(w)
    return words, codes


def meanings(lines: Iterable[str]) -> dict[str, frozenset[int]]:
    """word -> the lines it stands in."""
    out: dict[str, set[int]] = {}
    for i, line in enumerate(lines):
        for w in line.split():
            out.setdefault(w, set()).add(i)
    return {w: frozenset(x) for w, x in out.items()}


def _grams(w: str) -> set[str]:
    w = f" {w} "
    return {w[i : i + 2] for i in range(len(w) - 1)}


def token_likeness(a: str, b: str, means: dict[str, frozenset[int]]) -> float:
    """1 for equal words, 0.9 for the same meaning, else the share of common letter pairs where it is high."""
    if a == b:
        return 1.0
    if means.get(a, frozenset()) & means.get(b, frozenset()):
        return 0.9
    common = len(a) if b.startswith(a) else len(b) if a.startswith(b) else len(_common_prefix(a, b))
    if common >= 5 or (common >= 4 and abs(len(a) - len(b)) <= 1):
        return 0.9
    ga, gb = _grams(a), _grams(b)
    dice = 2 * len(ga & gb) / (len(ga) + len(gb))
    return dice if dice >= 0.6 else 0.0


def _common_prefix(a: str, b: str) -> str:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return a[:n]


def _expanded(words: list[str], other: list[str]) -> list[str]:
    """An initialism among ``words`` replaced by the words of ``other`` it stands for."""
    out: list[str] = []
    for w in words:
        hit = None
        if 2 <= len(w) <= 5:
            for i in range(len(other) - len(w) + 1):
                if "".join(x[0] for x in other[i : i + len(w)]) == w:
                    hit = other[i : i + len(w)]
        out += hit or [w]
    return out


# --- similarity flooding ----------------------------------------------------------------------------------------------


class _Side:
    """One schema: headers, tokens, codes, kinds and figures of its columns."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.headers = list(rows["header"])
        self.kind = list(rows["usual"])
        self.parent = list(rows["parent"])
        self.parts = [_tokens(h[len(p) + 1 :] if p else h) for h, p in zip(self.headers, self.parent)]
        n = rows["n_num"].to_numpy(float)
        with np.errstate(all="ignore"):
            self.mean = rows["sum_log"].fillna(0).to_numpy(float) / n
            self.sd = np.sqrt(np.maximum(rows["sum_log2"].fillna(0).to_numpy(float) / n - self.mean**2, 0.01))
            self.neg = rows["n_negative"].to_numpy(float) / n
            self.whole = rows["n_whole"].to_numpy(float) / n
            self.clear = sum(rows[f"n_{k}"].to_numpy(float) for k in KINDS)
            self.numeric = n > 0.8 * self.clear
        self.n = n


def _compatible(a: _Side, i: int, b: _Side, j: int, fact: dict | None) -> float:
    """How well the values of two columns may be of one quantity, from 0 (can't) to 1; names play no part."""
    if min(a.clear[i], b.clear[j]) == 0:
        return 0.7
    if a.numeric[i] != b.numeric[j]:
        return 0.0
    if a.numeric[i]:
        sd = max(a.sd[i], b.sd[j])
        noise = 2.5 * sd * math.sqrt(1 / a.n[i] + 1 / b.n[j])
        gap = max(0.0, abs(a.mean[i] - b.mean[j]) - noise) / sd
        signs = abs(a.neg[i] - b.neg[j]) - 2.5 * math.sqrt(0.25 / a.n[i] + 0.25 / b.n[j]) * 0.8
        spread = abs(math.log(a.sd[i] / b.sd[j]))
        return math.exp(-2.5 * gap) * (1 - min(1.0, 3 * max(0.0, signs))) * math.exp(-max(0.0, spread - 0.35))
    if fact is None or not fact["old_values"] or not fact["new_values"]:
        return 0.5
    if fact["value_likeness"] >= 0.3 or fact["surplus"] >= 0.3:
        return 1.0
    flags = max(fact["old_values"], fact["new_values"]) <= 3
    return 0.6 if flags else 0.05


def _name_likeness(a: _Side, i: int, b: _Side, j: int, weight: dict[str, float], means: dict[str, frozenset[int]]) -> float:
    (wa, ca), (wb, cb) = a.parts[i], b.parts[j]
    if ca and cb:
        if ca & cb:
            return 1.0
        if {x[0] for x in ca} & {x[0] for x in cb}:
            return -1.0  # two codes of one scheme name two quantities
    wa, wb = _expanded(wa, wb), _expanded(wb, wa)
    if not wa or not wb:
        return 0.0
    w = lambda t: weight.get(t, 2.0)
    best_a = [max(token_likeness(x, y, means) for y in wb) for x in wa]
    best_b = [max(token_likeness(x, y, means) for x in wa) for y in wb]
    sa, sb = sum(map(w, wa)), sum(map(w, wb))
    hit_a = sum(w(x) * s for x, s in zip(wa, best_a))
    hit_b = sum(w(y) * s for y, s in zip(wb, best_b))
    even, inside = (hit_a + hit_b) / (sa + sb), max(hit_a / sa, hit_b / sb)
    return 0.5 * even + 0.5 * inside


def flood(
    old: pd.DataFrame, new: pd.DataFrame, facts: dict[tuple[str, str], dict], *, flow: float = 0.35, rounds: int = 100, same: Iterable[str] = SAME_MEANING
) -> np.ndarray:
    """Settled similarity of every old with every new column.

    Pair nodes are (column, column), (token, token), (kind, kind) and (object, object).  An edge joins (c, c') with (t, t')
    where t is a token of c and t' of c', with (k, k') of their kinds, and with (o, o') of the objects they lie in.  In a round each node becomes the mean of its first value and,
    with weight ``flow``, what flows in along its edges; flows are means too, so values stay within 0..1 and settle.  It
    ends when no value moves by 0.0001.
    """
    a, b, means = _Side(old), _Side(new), meanings(same)
    heads = [set(p[0]) for p in a.parts + b.parts]
    seen: dict[str, int] = {}
    for h in heads:
        for t in h:
            seen[t] = seen.get(t, 0) + 1
    weight = {t: 0.3 if t in "% no number".split() else 1 + math.log(len(heads) / k) for t, k in seen.items()}
    na, nb = len(a.headers), len(b.headers)
    start = np.zeros((na, nb))
    cap = np.ones((na, nb))
    for i in range(na):
        for j in range(nb):
            if a.headers[i] == b.headers[j]:
                start[i, j] = 1.0
                continue
            fact = facts.get((a.headers[i], b.headers[j]))
            name = _name_likeness(a, i, b, j, weight, means)
            fit = _compatible(a, i, b, j, fact)
            value = fact["surplus"] if fact else 0.0
            if fact and not a.numeric[i] and max(fact["old_values"], fact["new_values"]) > 1 and fact["mean_length"] >= 2:
                value = max(value, fact["value_likeness"])
            cap[i, j] = 0.0 if name < 0 else fit
            start[i, j] = cap[i, j] * (1 - (1 - max(0.0, name)) * (1 - 0.95 * max(0.0, value)))
    ta = sorted({t for p in a.parts for t in p[0]})
    tb = sorted({t for p in b.parts for t in p[0]})
    # Edges column-token and column-kind of each side; a pair node takes the mean over the larger of its two edge lists.
    ma = np.array([[t in p[0] for t in ta] for p in a.parts], float).reshape(na, len(ta))
    mb = np.array([[t in p[0] for t in tb] for p in b.parts], float).reshape(nb, len(tb))
    ka = np.array([[k == x for x in KINDS] for k in a.kind], float).reshape(na, len(KINDS))
    kb = np.array([[k == x for x in KINDS] for k in b.kind], float).reshape(nb, len(KINDS))
    # Nesting: columns and the objects they lie in; a column at the top lies in none.
    oa, ob = sorted({p for p in a.parent if p}), sorted({p for p in b.parent if p})
    pa_, pb_ = (np.array([[p == o for o in objs] for p in x.parent], float).reshape(n, len(objs)) for x, objs, n in ((a, oa, na), (b, ob, nb)))
    obj0 = np.array([[1.0 if x == y else 0.5 if x.split(".")[-1] == y.split(".")[-1] else 0.1 for y in ob] for x in oa]).reshape(len(oa), len(ob))
    larger = lambda m, n, axis: np.maximum(np.maximum.outer(m.sum(axis), n.sum(axis)), 1.0)
    tok0 = np.array([[token_likeness(x, y, means) for y in tb] for x in ta]).reshape(len(ta), len(tb))
    col, tok, kin, obj = start.copy(), tok0.copy(), np.eye(len(KINDS)), obj0.copy()
    for _ in range(rounds):
        to_col = 0.8 * (ma @ tok @ mb.T) / larger(ma, mb, 1) + 0.2 * (ka @ kin @ kb.T)
        inside = pa_ @ obj @ pb_.T
        to_col = np.where(np.outer(pa_.any(1), pb_.any(1)), 0.8 * to_col + 0.2 * inside, to_col)
        to_tok = (ma.T @ col @ mb) / larger(ma, mb, 0)
        to_kin = (ka.T @ col @ kb) / larger(ka, kb, 0)
        col2 = np.where(start > 0, (start + flow * cap * to_col) / (1 + flow), 0.0)
        tok2 = np.where(tok0 > 0, (tok0 + flow * to_tok) / (1 + flow), 0.0)
        kin2 = (np.eye(len(KINDS)) + flow * to_kin) / (1 + flow)
        obj = (obj0 + flow * (pa_.T @ col @ pb_) / larger(pa_, pb_, 0)) / (1 + flow)
        moved = np.abs(col2 - col).max(initial=0.0)
        col, tok, kin = col2, tok2, kin2
        if moved < 1e-4:
            break
    return col


def renames(
    old: pd.DataFrame, new: pd.DataFrame, facts: dict[tuple[str, str], dict], accept: float = 0.36, same: Iterable[str] = SAME_MEANING
) -> list[tuple[str, str, float]]:
    """One-to-one correspondences of lost and gained headers: best settled score first, down to ``accept``."""
    lost = sorted(set(old["header"]) - set(new["header"]))
    gained = sorted(set(new["header"]) - set(old["header"]))
    if not lost or not gained:
        return []
    score = flood(old, new, facts, same=same)
    oi, nj = {h: i for i, h in enumerate(old["header"])}, {h: j for j, h in enumerate(new["header"])}
    ranked = sorted(((float(score[oi[x], nj[y]]), x, y) for x in lost for y in gained), key=lambda r: (-r[0], r[1], r[2]))
    used: set[tuple[int, str]] = set()
    out = []
    for s, x, y in ranked:
        if s >= accept and (0, x) not in used and (1, y) not in used:
            used |= {(0, x), (1, y)}
            out.append((x, y, s))
    return out


# --- changes ----------------------------------------------------------------------------------------------------------

CHANGES = "family string, edition string, change_kind string, old_field string, new_field string, score double"


def value_facts(cell_rows: DataFrame, gone: DataFrame, came: DataFrame) -> DataFrame:
    """Facts of pairs of a lost and a gained column from their values: how often an entity has the same value in both
    beyond chance (``surplus``), and how alike the sets of values are (``value_likeness``).

    ``cell_rows``: family, edition, entity, header, text.  ``gone`` and ``came``: family, edition (the later one's),
    before (the edition before), header.
    """
    # A figure is the same value however it is written.
    value = F.coalesce(F.col("num").cast("string"), F.lower(F.regexp_replace("text", "[^\\p{L}\\p{N}.-]", "")))
    lost = gone.select("family", F.col("before").alias("edition"), F.col("edition").alias("later"), "header")
    either = lost.drop("later").unionByName(came.select("family", "edition", "header")).distinct()
    plain = cell_rows.where("text is not null").join(F.broadcast(either), ["family", "edition", "header"], "left_semi")
    plain = plain.select("family", "edition", "entity", "header", value.alias("v"))
    plain = plain.withColumn("v", F.when(F.col("v").isin("y", "yes"), "true").when(F.col("v").isin("n", "no"), "false").otherwise(F.col("v")))
    plain = staged(plain, "values")  # of the lost and gained columns only; the cells themselves are not read again
    old = plain.join(F.broadcast(lost), ["family", "edition", "header"]).select(
        "family", F.col("later").alias("edition"), "entity", F.col("header").alias("old"), F.col("v").alias("ov")
    )
    new = plain.join(F.broadcast(came.select("family", "edition", "header")), ["family", "edition", "header"]).select(
        "family", "edition", "entity", F.col("header").alias("new"), F.col("v").alias("nv")
    )
    oc = old.groupBy("family", "edition", "old", "ov").agg(F.count(F.lit(1)).alias("on"))
    nc = new.groupBy("family", "edition", "new", "nv").agg(F.count(F.lit(1)).alias("nn"))
    ot = oc.groupBy("family", "edition", "old").agg(
        F.count(F.lit(1)).alias("old_values"), F.sum("on").alias("ot"), F.coalesce(F.avg(F.when(~F.col("ov").isin("true", "false"), F.length("ov"))), F.lit(0.0)).alias("mean_length")
    )
    nt = nc.groupBy("family", "edition", "new").agg(F.count(F.lit(1)).alias("new_values"), F.sum("nn").alias("nt"))
    both = (
        oc.join(nc.withColumnRenamed("nv", "ov"), ["family", "edition", "ov"])
        .groupBy("family", "edition", "old", "new")
        .agg(F.count(F.lit(1)).alias("common"), F.sum(F.col("on").cast("double") * F.col("nn")).alias("meet"))
    )
    one_old = old.where("entity is not null").groupBy("family", "edition", "entity", "old").agg(F.max("ov").alias("ov"))
    one_new = new.where("entity is not null").groupBy("family", "edition", "entity", "new").agg(F.max("nv").alias("nv"))
    same = (
        one_old.join(one_new, ["family", "edition", "entity"])
        .groupBy("family", "edition", "old", "new")
        .agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("ov") == F.col("nv")).alias("equal"))
    )
    keys = ["family", "edition", "old", "new"]
    out = ot.join(nt, ["family", "edition"]).join(both, keys, "left").join(same, keys, "left").fillna(0)
    chance = F.try_divide(F.col("meet"), F.col("ot").cast("double") * F.col("nt"))
    # Shrunk towards chance by five entities' worth, so that a few of them say little and there is no threshold.
    observed = (F.col("equal") + 5 * chance) / (F.col("shared") + 5)
    surplus = F.when(chance < 0.99, (observed - chance) / (1 - chance))
    return out.select(
        *keys, "old_values", "new_values", "mean_length",
        F.greatest(F.coalesce(surplus, F.lit(0.0)), F.lit(0.0)).alias("surplus"),
        (F.col("common") / F.greatest("old_values", "new_values")).alias("value_likeness"),
    )


def _compare(columns: pd.DataFrame, evidence: pd.DataFrame, same: Iterable[str] = SAME_MEANING) -> pd.DataFrame:
    """The changes from one edition to the next of one family."""
    out: list[tuple] = []
    if len(columns):
        family, edition = columns["family"].iloc[0], columns["edition"].iloc[0]
        old = columns[columns["side"] == "old"].sort_values("header").reset_index(drop=True)
        new = columns[columns["side"] == "new"].sort_values("header").reset_index(drop=True)
        facts = {(r["old"], r["new"]): r for r in evidence.to_dict("records")}
        pairs = renames(old, new, facts, same=same)
        moved_old, moved_new = {p[0] for p in pairs}, {p[1] for p in pairs}
        out += [(family, edition, "renamed", x, y, s) for x, y, s in pairs]
        ho, hn = dict(zip(old["header"], old["usual"])), dict(zip(new["header"], new["usual"]))
        out += [(family, edition, "removed", h, "", None) for h in ho if h not in hn and h not in moved_old]
        out += [(family, edition, "added", "", h, None) for h in hn if h not in ho and h not in moved_new]
        out += [(family, edition, "retyped", h, h, None) for h in ho if h in hn and ho[h] and hn[h] and ho[h] != hn[h]]
    return pd.DataFrame(out, columns=["family", "edition", "change_kind", "old_field", "new_field", "score"])


def schema_changes(cell_rows: DataFrame, same: Iterable[str] = SAME_MEANING) -> DataFrame:
    """Changes of columns between successive editions of each family, from ``cells`` with the columns ``family``,
    ``edition`` (ordered as text) and ``entity``.

    change_kind is added (empty ``old_field``), removed (empty ``new_field``), renamed (with ``score``) or retyped (the
    usual JSON type changed; suppression codes don't count).  Columns whose cells are all codes have no type and are not
    retyped.  Rows without family or edition are left out.  The first edition has no changes; no rows give no changes.
    ``same``: lines of words that mean the same in headers, evidence beside the letters of names and the values.
    """
    known = cell_rows.where("header is not null and family is not null and edition is not null")
    prof = profiles(known, ["family", "edition"]).withColumn("usual", usual_kind())
    prof = staged(prof, "profiles")
    steps = prof.select("family", "edition").distinct()
    steps = steps.withColumn("before", F.lag("edition").over(Window.partitionBy("family").orderBy("edition"))).where(
        "before is not null"
    )
    new = prof.join(steps, ["family", "edition"]).withColumn("side", F.lit("new"))
    old = (
        prof.withColumnRenamed("edition", "before")
        .join(steps, ["family", "before"])
        .withColumn("side", F.lit("old"))
        .select(*new.columns)
    )
    keys = ["family", "edition", "header"]
    gone = old.join(new.select(*keys), keys, "left_anti").select("family", "edition", "before", "header")
    came = new.join(old.select(*keys), keys, "left_anti").select("family", "edition", "before", "header")
    facts = value_facts(known, gone, came)
    both = old.unionByName(new)
    return both.groupBy("family", "edition").cogroup(facts.groupBy("family", "edition")).applyInPandas(lambda c, e: _compare(c, e, same), CHANGES)


def canonical_names(columns: Iterable[tuple[str, str, str]], changes: Iterable[tuple[str, str, str, str]]) -> dict[tuple[str, str, str], str]:
    """(family, edition, header) -> the name under which the quantity is kept: the last header of its chain of renames.

    ``columns``: family, edition, header.  ``changes``: family, edition, old, new of the renames.  Where chains of renames
    would give one name to two columns of an edition, the one that had the name first keeps it for its own editions as
    ``name (to edition)``.
    """
    links = {(f, e, o): n for f, e, o, n in changes}
    editions: dict[str, set[str]] = {}
    have: set[tuple[str, str, str]] = set(columns)
    for f, e, _ in have:
        editions.setdefault(f, set()).add(e)
    out, ends = {}, {}
    for f, e, h in sorted(have):
        name, until = h, e
        for later in sorted(x for x in editions[f] if x > e):
            name = links.get((f, later, name), name)
            if (f, later, name) in have:
                until = later
        out[f, e, h], ends[f, e, h] = name, until
    held: dict[tuple[str, str, str], list[str]] = {}
    for (f, e, h), name in out.items():
        held.setdefault((f, e, name), []).append(h)
    clash = {(f, name) for (f, _, name), hs in held.items() if len(hs) > 1}
    for f, name in sorted(clash):
        at = [k for k, n in out.items() if k[0] == f and n == name]
        last = max(ends[k] for k in at)
        for k in at:
            if ends[k] < last or (k[2] != name and len(held[f, k[1], name]) > 1 and ends[k] == last and name in held[f, k[1], name]):
                out[k] = f"{name} (to {ends[k]})" if ends[k] < last else f"{name} (from {k[2]})"
    return out


def united(cell_rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """One row per ``keys`` (with family and edition) under the last name of every quantity: ``lines``, the figures by name,
    and ``texts``, what isn't a figure.

    A name whose usual kind is number in any edition is cast to number everywhere; its cells that hold no figure stay texts.
    Only codes of suppression are left out.  The names, as many as there are columns in all files, are read to the driver to
    follow the renames.  Cells without family or edition are left out.
    """
    spark = cell_rows.sparkSession
    cell_rows = cell_rows.where("header is not null and family is not null and edition is not null")
    prof = staged(profiles(cell_rows, ["family", "edition"]).withColumn("usual", usual_kind()), "columns")
    cols = prof.select("family", "edition", "header", (F.col("n_num") * 2 > sum((F.col(f"n_{k}") for k in KINDS), F.lit(0))).alias("figure")).collect()
    moved = changes.where("change_kind = 'renamed'").select("family", "edition", "old_field", "new_field").collect()
    names = canonical_names([(r.family, r.edition, r.header) for r in cols], [tuple(r) for r in moved])
    figures = {(r.family, names[r.family, r.edition, r.header]) for r in cols if r.figure}
    rows = [(f, e, h, n, (f, n) in figures) for (f, e, h), n in names.items()]
    dim = spark.createDataFrame(rows, "family string, edition string, header string, name string, figure boolean")
    named = cell_rows.where("text is not null").join(F.broadcast(dim), ["family", "edition", "header"])
    castable = F.col("figure") & F.col("num").isNotNull()
    figure = F.when(castable, F.struct("name", "num"))
    text = F.when(~castable, F.struct("name", "text"))
    # Two headers of one edition can't share a name, so each name comes once in a row.
    return named.groupBy(*keys, "family", "edition").agg(
        F.map_from_entries(F.collect_list(figure)).alias("lines"), F.map_from_entries(F.collect_list(text)).alias("texts")
    )
