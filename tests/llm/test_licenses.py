import math
import re
from collections import Counter

from parcelflow.llm import licenses as L

FILES = [
    (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.txt", "no notice here"), (3, "a/b/COPYING.md", "first\nLicensed under the Apache License, Version 2.0.\nlast"),
    (4, "a/b/y.txt", "text\nAll rights reserved.\n"), (5, "ab/z.txt", "plain"), (6, "top.txt", "plain"), (7, "a/b/c/d/e/deep.py", None),
    (8, "a/q.txt", ""), (9, None, "Licensed under CC BY-NC 4.0."), (10, None, "none"), (11, "a/LICENSE", "All rights reserved"), (12, "c/NOTICE", "nothing of note"),
    (13, "c/n.txt", "the of under license the"), (None, "a/b/w.txt", "word " * 50_000), (14, "a/b/licensed.txt", "Released under the MIT License"),
    (14, "a/b/licensed.txt", "Released under the MIT License"), (15, "a/b/k.txt", "This software: LICENSED under the gnu general public license - version 3!"),
]


def plain(files):
    n = len(files)
    toks = lambda s: re.findall("[a-z0-9]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in s or ""))
    df = Counter(t for _, _, s in files for t in set(toks(s)))
    known = {t for _, s in L.TEMPLATES for t in toks(s)}
    w = lambda t: math.floor(1000 * (1 + math.log((n + 1) / ((df[t] if t in known else 0) + 1))))

    def own(text):
        best = (0.0, 0)
        for line in (text or "").split("\n"):
            a = {t: c * w(t) for t, c in Counter(toks(line)).items()}
            for i, (_, s) in enumerate(L.TEMPLATES):
                b = {t: c * w(t) for t, c in Counter(toks(s)).items()}
                dot = sum(x * b.get(t, 0) for t, x in a.items())
                if dot:
                    best = max(best, (dot / math.sqrt(float(sum(x * x for x in a.values())) * float(sum(x * x for x in b.values()))), -i))
        return (L.TEMPLATES[-best[1]][0], best[0]) if best[0] >= L.THRESHOLD else None

    found = [(i, p, own(t)) for i, p, t in files]
    grants = {}
    for i, p, o in found:
        if o and p and re.fullmatch(r"(?i)(license|licence|copying|notice)(\..*)?", p.split("/")[-1]):
            folder = "/".join(p.split("/")[:-1])
            grants[folder] = min(grants.get(folder, (0, "")), (-o[1], o[0]))
    out = []
    for i, p, o in found:
        if o:
            out.append((i, p, *o, "own", None))
            continue
        folder = None if p is None else p.split("/")[:-1]
        while folder is not None and "/".join(folder) not in grants:
            folder = folder[:-1] if folder else None
        if folder is None:
            out.append((i, p, None, None, "none", None))
        else:
            s, name = grants["/".join(folder)]
            out.append((i, p, name, -s, "inherited", "/".join(folder)))
    return out


def test_equals_brute_force(spark):
    df = spark.createDataFrame([(t, p, i, "x", 0.1) for i, p, t in FILES], "text string, path string, doc_id long, dir string, own double")
    got = [tuple(r) for r in L.scan(df, "doc_id").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain(FILES)))
    by = {r[0]: r for r in got}
    assert by[2][2] == "apache-2.0" and by[4][2] == "proprietary" and by[8][2] in ("mit", "proprietary") and by[15][2] == "gpl-3.0"
    assert L.scan(df.where("false"), "doc_id").count() == 0


def test_shortcut_skips_no_line():
    n, freq = 5000, {b"the": 4000, b"under": 900, b"license": 30, b"of": 4500, b"this": 3000, b"is": 3500, b"and": 4800, b"in": 4700, b"to": 4000}
    scanner = L.Scanner(L.TEMPLATES, n, freq, L.THRESHOLD)
    assert 0 < len(scanner.needed) < len(scanner.weight)
    import random
    rng = random.Random(3)
    known = sorted(scanner.weight)
    for _ in range(3000):
        line = b" ".join(rng.choice(known) if rng.random() < 0.8 else b"other" for _ in range(rng.randint(1, 9)))
        best = scanner.line(line)
        if best and best[0] >= L.THRESHOLD:
            assert scanner.text(line.decode())[0] is not None
