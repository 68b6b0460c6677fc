import hashlib
import random
import zlib

from tests.llm.cases import ROWS, documents, empty

from sieveline.llm import merkle

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def joined(*digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf(row, change=lambda t: t):
    doc_id, text, lang, source = row
    fields = (doc_id, source, lang, None if text is None else len(text), None if text is None else change(text))
    return joined(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def climb(digests, fanout):
    """The root, and for each digest its (before, after) at each level."""
    paths, below = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        runs = [range(a, min(a + fanout, len(digests))) for a in range(0, len(digests), fanout)]
        for run in runs:
            for j in run:
                for i in below[j]:
                    paths[i].append((digests[run[0] : j], digests[j + 1 : run[-1] + 1]))
        digests, below = [joined(*(digests[j] for j in run)) for run in runs], [[i for j in run for i in below[j]] for run in runs]
    return digests[0], paths


def brute(rows, fanout):
    groups = {}
    for row in rows:
        own = leaf(row)
        tampered = row[0] is not None and row[1] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
        groups.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, own, leaf(row, lambda t: t.translate(LOW)) if tampered else own, row[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        groups[name].sort()
    trees = [climb([g[2] for g in groups[name]], fanout) for name in names]
    root, top = climb([t[0] for t in trees], fanout) if trees else ("", [])
    out = []
    for name, (subroot, paths), above in zip(names, trees, top, strict=True):
        for g, path in zip(groups[name], paths, strict=True):
            path, found = path + above, g[3]
            for before, after in path:
                found = joined(*before, found, *after)
            out.append((g[4], g[2], subroot, root, joined(*(x for before, after in path for x in (*before, *after))), found, found == root))
    return sorted(out, key=repr)


def check(spark, rows, fanout):
    assert sorted((tuple(r) for r in merkle.audit(documents(spark, rows), fanout).collect()), key=repr) == brute(rows, fanout)


def test_odd_rows(spark):
    check(spark, ROWS, 16)
    assert merkle.audit(empty(spark)).count() == 0


def test_levels_of_every_shape(spark):
    draw = random.Random(5)
    rows = [(i, f"Text {i}", draw.choice(["en", None]), draw.choice(["a"] * 20 + ["b", "c", "d", "é", "", None])) for i in range(300)]
    rows += [(1000 + i, "Alone", "en", f"s{i}") for i in range(9)]
    check(spark, rows, 3)


def test_a_proof_finds_what_was_changed(spark):
    rows = [(i, f"text {i}", "en", "ab"[i % 2]) for i in range(40)]
    manifest = merkle.build(documents(spark, rows), merkle.leaf_digest(), "source", "doc_id", fanout=4)
    root = manifest.root.first()["root"]
    paths = [(r.digest, r.path) for r in manifest.paths().collect()]
    assert len(paths) == 40
    for digest, path in paths:
        for start, fine in ((digest, True), (joined(digest), False)):
            found = start
            for step in path:
                found = joined(step.before, found, step.after)
            assert (found == root) is fine
