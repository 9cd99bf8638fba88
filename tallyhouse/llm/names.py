"""Names of schools as people type them: expansion, distinctive tokens, and soft similarity of two names."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Abbreviations in names of schools, each with the word it stands for.
ABBREVIATIONS = {
    "st": "saint", "pk": "park", "hl": "hall", "grn": "green", "ln": "lane", "la": "lane", "rd": "road", "x": "cross",
    "cr": "cross", "crs": "cross", "str": "street", "ave": "avenue", "sch": "school", "schl": "school", "pri": "primary",
    "prim": "primary", "ps": "primary", "jmi": "primary", "inf": "infant", "infs": "infant", "infants": "infant",
    "jnr": "junior", "jnrs": "junior", "jun": "junior", "juns": "junior", "juniors": "junior", "sec": "secondary", "hs": "high",
    "acad": "academy", "aca": "academy", "nurs": "nursery", "nsy": "nursery", "nur": "nursery", "spec": "special", "cath": "rc",
    "catholic": "rc", "cofe": "ce", "coll": "college", "ald": "alderman", "comm": "community", "schools": "school",
    "cp": "primary", "ss": "saint", "thro": "through", "ft": "first", "mid": "middle",
}

#: Phrases that stand for one word.
PHRASES = (
    (r"\bch(urch)?\.? ?of ?eng(land)?\b\.?", " ce "), (r"\bc\.? ?of ?e\b\.?", " ce "), (r"\bc ?[./] ?e\b\.?", " ce "),
    (r"\bcofe\b", " ce "), (r"\brom(an)?\.? ?cath(olic)?\b\.?", " rc "), (r"\br ?[./] ?c\b\.?", " rc "),
    (r"\bp\. ?s\.?(?=\W|$)", " primary "), (r"\bh\. ?s\.?(?=\W|$)", " high "), (r"\bc\. ?p\.?(?=\W|$)", " primary "), (r"\ball[- ]?thro(ugh|')?", " allthrough "),
    (r"\bv\.? ?a\b\.?", " "), (r"\bv\.? ?c\b\.?", " "), (r"\bchildrens centre\b", " "), (r"\ba voluntary academy\b", " "),
    (r"\bvoluntary (controlled|aided)\b", " "), (r"\bprimary and nursery\b", " primary "), (r"\binfant and nursery\b", " infant "),
    (r"\bcommunity college\b", " secondary "), (r"\binfants? and juniors?\b", " infant junior "),
)

#: Words that tell kinds of school, and the group of kinds that may stand for each other.
KINDS = {
    "infant": "infant", "junior": "junior", "primary": "primary", "first": "primary", "secondary": "secondary", "high": "secondary",
    "college": "secondary", "nursery": "nursery", "special": "special", "allthrough": "allthrough", "academy": "academy",
    "middle": "middle", "ce": "ce", "rc": "rc",
}

#: Words of names that tell nothing about which school is meant.
EMPTY_WORDS = frozenset(
    "the a an of and at in for school academy community voluntary controlled aided va vc trust centre foundation our".split()
)
TITLES = frozenset("sir dame lady alderman saint".split())
#: Common second words of names of places and roads; they weigh less than any other word.
COMMON = frozenset("street road lane green park hall cross hill way avenue sands magna market great nether kirk".split())
_FUZZY = sorted(
    w for w in {*KINDS, "school", "primary", "street", "green", "cross", "community", "england", "church", "infants", "juniors"} if len(w) >= 5
)
_DIGITS = str.maketrans("01358", "olesb")


def squeeze(text: str | None) -> str:
    """Lower case without accents; apostrophes gone, look-alike digits inside words as letters."""
    if not text:
        return ""
    t = unicodedata.normalize("NFKD", text)
    t = "".join(c for c in t if not unicodedata.combining(c))
    t = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", t)
    t = t.lower().replace("’", "'").replace("`", "'")
    t = re.sub(r"(?<=[a-z])'(?=s\b)|'", "", t).replace("&", " and ")
    return re.sub(r"(?<=[a-z])[01358]|[01358](?=[a-z])", lambda m: m.group().translate(_DIGITS), t)


@lru_cache(maxsize=100_000)
def edits(a: str, b: str, most: int = 99) -> int:
    """Edit distance with swaps of neighbours, or ``most`` + 1 where it is larger than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


@lru_cache(maxsize=200_000)
def _word(w: str) -> str:
    """An abbreviation expanded, or a mistyped common word put right."""
    if w in ABBREVIATIONS:
        return ABBREVIATIONS[w]
    if w in KINDS or w in EMPTY_WORDS or w in COMMON:
        return w
    if len(w) == 4:
        for short in ("prim", "acad", "cath", "nurs", "spec"):
            if sorted(w) == sorted(short) and edits(w, short, 1) == 1:
                return ABBREVIATIONS[short]
    if len(w) >= 4:
        for known in _FUZZY:
            if abs(len(known) - len(w)) <= 1 and edits(w, known, 1) <= 1 and w[0] == known[0]:
                return ABBREVIATIONS.get(known, known)
        if len(w) >= 6:
            for known in ("primary", "school", "secondary", "infants", "juniors", "academy", "nursery", "street"):
                if edits(w, known, 2) <= (2 if len(known) >= 7 else 1):
                    return ABBREVIATIONS.get(known, known)
    return w


def analyse(text: str | None) -> tuple[list[str], list[str]]:
    """(distinctive words in order, sorted kinds) of a typed name; of null and empty names both are empty."""
    t = squeeze(text)
    t = re.sub(r"\bst ?\.(?=\w)", "st ", t)
    for pattern, word in PHRASES:
        t = re.sub(pattern, word, t)
    # "High Grove" is a name, "Grove High" and "High School, Grove" tell a kind.
    t = re.sub(r"\bhigh[- ](?!(s[a-z]*h[a-z]*l?|acad[a-z]*|pri[a-z]*)\b)(?=[a-z]{3})", "high", t)
    words = re.findall(r"[a-z]+", t)
    core: list[str] = []
    kinds: set[str] = set()
    for i, w in enumerate(words):
        if w == "s" and core and i:
            core[-1] += "s"
            continue
        full = _word(w)
        if w == "st":  # before another word of the name it is a saint, after one a street
            after = _word(words[i + 1]) if i + 1 < len(words) else ""
            full = "saint" if after and after not in KINDS and after not in EMPTY_WORDS else "street" if core else "saint"
        if full in KINDS:
            kinds.add(KINDS[full])
        elif full not in EMPTY_WORDS:
            core.append(full)
    return core, sorted(kinds)


def without_place(core: list[str], place: list[str]) -> list[str]:
    """The words without those of the place at their start or end, unless nothing else would be left."""
    n = len(place)
    if n and len(core) > n:
        for part, rest in ((core[-n:], core[:-n]), (core[:n], core[n:])):
            if all(word_likeness(a, b) >= 0.7 for a, b in zip(part, place)):
                return rest
    return core


def grams(core: list[str], q: int = 3) -> list[str]:
    """Letter q-grams of the words written together."""
    s = "".join(core)
    if not s:
        return []
    s = f"^{s}$"
    return sorted({s[i : i + q] for i in range(max(1, len(s) - q + 1))})


@lru_cache(maxsize=200_000)
def word_likeness(a: str, b: str) -> float:
    """1 for equal words, less for mistyped ones, 0.75 for an initial of the other, else 0."""
    if a == b or a + "s" == b or b + "s" == a:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.75 if a[0] == b[0] else 0.0
    for x in (a, a[:-1] if a.endswith("s") else a):
        if len(x) >= 4 and b.startswith(x):
            return 0.74
    n = max(len(a), len(b))
    most = 1 if n <= 5 else 2 if n <= 13 else 3
    d = edits(a, b, most)
    return 1 - d / n if d <= most and n - d >= 3 else 0.0


def soft_score(typed: list[str], name: list[str], weights: list[float], place: list[str]) -> float:
    """Weighted share of words two names have in common, from 0 to 1; mistyped words count in part, rare words more.

    ``weights`` belong to ``name``; ``place`` are words of the place that a typed name may carry besides.  Words written
    together or apart are found by comparing the names without spaces.
    """
    if not typed or not name:
        return 0.0
    left = list(typed)
    for p in place:
        if len(left) > 1 and p not in name:
            for i, w in enumerate(left):
                if word_likeness(w, p) >= 0.75 and len(w) > 1:
                    del left[i]
                    break
    best = 0.0
    for words in ([typed, left] if left != list(typed) else [typed]):
        total, common, used = sum(weights), 0.0, set()
        for w, weight in sorted(zip(name, weights), key=lambda x: -x[1]):
            likes = [(word_likeness(t, w), -i) for i, t in enumerate(words) if i not in used]
            like, at = max(likes, default=(0.0, 0))
            if like > 0:
                used.add(-at)
                common += weight * like
                if w in TITLES:
                    continue
            elif w in TITLES:
                total -= weight * 0.8
        free = [i for i in range(len(words)) if i not in used]
        extra = sum(0.3 if words[i] in COMMON or words[i] in TITLES else 1.0 for i in free)
        rest = (total / max(1, len(name))) * extra
        even = 2 * common / (2 * total + rest) if total else 0.0
        if not [i for i in free if words[i] not in TITLES] and total and common >= 0.3 * total:
            # A short form: every typed word is in the name, but not the other way round.
            sure = sum(max(word_likeness(t, w) for w in name) for t in words) / len(words)
            even = max(even, 0.55 * sure + 0.45 * even)
        a, b = "".join(words), "".join(name)
        n = max(len(a), len(b))
        most = 1 if n <= 5 else 2 if n <= 15 else 3
        d = edits(a, b, most)
        tight = 1 - d / n if d <= most and n > 2 * d else 0.0
        best = max(best, even, tight)
    return best


_CLASH = {
    frozenset(p)
    for p in (
        ("infant", "junior"), ("infant", "secondary"), ("junior", "secondary"), ("primary", "secondary"), ("nursery", "secondary"),
        ("nursery", "primary"), ("nursery", "junior"), ("special", "primary"), ("special", "secondary"), ("special", "nursery"),
        ("special", "infant"), ("special", "junior"), ("allthrough", "primary"), ("allthrough", "infant"), ("allthrough", "junior"), ("allthrough", "nursery"),
    )
}

#: The kinds that go with a phase of the register.
PHASE_KINDS = {
    "primary": {"primary", "infant", "junior"}, "secondary": {"secondary"}, "nursery": {"nursery"},
    "all-through": {"allthrough"}, "not applicable": {"special"},
}


def kind_score(typed: list[str], name: list[str], typed_phase: str | None, phase: str | None) -> float:
    """From -1 (the kinds of school exclude each other) through 0 (nothing to say) to 1 (they agree)."""
    a, b = set(typed) - {"academy", "ce", "rc"}, set(name) - {"academy", "ce", "rc"}
    pa, pb = (typed_phase or "").lower(), (phase or "").lower()
    s = 0.0
    if a and b:
        s = 1.0 if a == b else 0.6 if a & b else -1.0 if any(frozenset((x, y)) in _CLASH for x in a for y in b) else -0.3
    elif a and pb:
        s = 0.5 if a & PHASE_KINDS.get(pb, set()) else -0.8 if pb in PHASE_KINDS and pb != "not applicable" else -0.2
    if pa and pb:
        s += 0.3 if pa == pb else -0.6
    ra, rb = {"ce", "rc"} & set(typed), {"ce", "rc"} & set(name)
    if ra and rb and ra != rb:
        s -= 0.8
    elif ra != rb:
        s -= 0.15 if ra else 0.05
    return max(-1.0, min(1.0, s))
