import random

import numpy as np

from tallyhouse.llm import subjects as S

WORDS = {"sport": "goal team match league captain", "law": "court clause appeal statute counsel", "music": "choir chord verse violin song"}
FILL = ["The office is open.", "Tea was served.", "Thank you for reading.", "Doors open at nine.", "See the letter about the {}."]


def text(rnd, subs):
    parts = []
    for s in subs:
        w = WORDS[s].split()
        parts.append(" ".join(f"The {rnd.choice(w)} and the {rnd.choice(w)} went well." for _ in range(4)))
    w = WORDS[rnd.choice(list(WORDS))].split()
    parts.append(" ".join(rnd.choice(FILL).format(rnd.choice(w)) for _ in range(4)))
    rnd.shuffle(parts)
    return "\n\n".join(parts)


def world(n, seed):
    rnd = random.Random(seed)
    names = list(WORDS)
    out = []
    for _ in range(n):
        subs = [s for s in names if rnd.random() < 0.4] or [rnd.choice(names)]
        out.append((text(rnd, subs), "web", subs))
    return out, names


def test_held_out():
    train, names = world(150, 1)
    test, _ = world(80, 2)
    y = np.array([[s in d[2] for s in names] for d in train])
    m = S.fit([d[0] for d in train], [d[1] for d in train], y, names)
    got, p = m.decode([d[0] for d in test], [None] * len(test))
    right = sum({m.subjects[j] for j in np.flatnonzero(g)} == set(d[2]) for g, d in zip(got, test))
    assert right >= 0.85 * len(test)
    assert ((p > 0) & (p <= 1.000001)).all()


def test_beam_is_the_best_combination():
    train, names = world(60, 3)
    y = np.array([[s in d[2] for s in names] for d in train])
    m = S.fit([d[0] for d in train], [d[1] for d in train], y, names)
    wide, p_wide = m.decode([d[0] for d in train], ["web"] * 60, beam=64)
    some, p_some = m.decode([d[0] for d in train], ["web"] * 60, beam=4)
    assert (p_some <= p_wide + 1e-9).all()
    assert (wide == some).all(axis=1).mean() > 0.95


def test_frames(spark):
    train, names = world(80, 4)
    rows = [(i, d[0], d[1]) for i, d in enumerate(train)] + [(900, None, "web"), (901, "", None), (902, "  \n", "web"), (903, train[0][0] * 400, "new"), (None, "x", "web")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, s) for i, d in enumerate(train) for s in d[2]] + [(1, "unknown"), (None, "law"), (0, train[0][2][0])], "doc_id long, subject string")
    m = S.fit_from(docs, labels, names, bound=60)
    got = {r.doc_id: r.subjects for r in S.label(docs, m).collect()}
    assert len(got) == 84
    assert got[900] == got[901] == got[902] == []
    assert set(got[903]) <= set(names)
    empty = S.fit_from(docs, labels.limit(0), names)
    assert all(r.subjects == [] for r in S.label(docs, empty).collect())
    assert S.label(docs.limit(0), m).collect() == []
