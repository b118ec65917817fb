import random
import re
from collections import defaultdict

import numpy as np

from boardloom.llm import lines


def _found(spark, rows):
    df = spark.createDataFrame(rows, "src string, doc string, text string, _fh string, letter int")
    return sorted(map(tuple, lines.Repeated(df, "src", "doc", "text").found().collect()))


def _brute(rows):
    docs, seen, at = defaultdict(set), defaultdict(set), defaultdict(set)
    for src, doc, text, *_ in rows:
        if src is None or doc is None:
            continue
        docs[src].add(doc)
        for n, line in enumerate((text or "").split("\n"), 1) if text else ():
            if any(map(str.isalpha, line)):
                key = src, re.sub(r"[\s0-9]", "", line.lower())
                seen[key].add(doc)
                at[key].add((doc, n))
    return sorted({x for k, v in seen.items() if len(v) >= 4 and len(v) * 4 >= len(docs[k[0]]) for x in at[k]})


def _rows(n=160):
    r = random.Random(3)
    words = "alpha beta gamma delta rail clock sheet probe hook limit".split()
    say = lambda: " ".join(r.choice(words) for _ in range(r.randint(2, 12))).capitalize() + "."
    notes = ["Page 1 of 25", "All rights reserved, Acme Inc.", "Sous réserve de modifications", "www.x.invalid/support", "Not for use in life support without written consent", "12 / 14", "---"]
    out = []
    for i in range(n):
        body = [say() for _ in range(r.randint(1, 9))]
        for k, note in enumerate(notes):
            if r.random() < (0.5 if k % 2 else 0.27):
                note = re.sub(r"\d+", lambda m: str(r.randint(1, 300)), note)
                note = r.choice([str, str.upper, lambda s: s.replace(" ", "  "), lambda s: f" {s}\t\r"])(note)
                body.insert(r.randint(0, len(body)), note)
        out.append((r.choice(["hot", "hot", "hot", "a", "b", "tiny"]), f"d{i}", "\n".join(body), "x", 1))
    out += [("a", "n1", None, "x", 1), ("a", "n2", "", "x", 1), (None, "n3", "x\ny", "x", 1), ("a", None, "x", "x", 1), ("b", "n4", "   \n\n \t", "x", 1)]
    return out + out[:20]


def test_against_brute_force(spark):
    rows = _rows()
    want = _brute(rows)
    assert want and _found(spark, rows) == want


def test_edges(spark):
    assert _found(spark, []) == []
    same = [("s", f"d{i}", "Keep out 3\n7\nbody %d x" % i, "x", 1) for i in range(4)]
    assert {n for _, n in _found(spark, same)} == {1, 3}  # digits are no difference, a line of digits has no letter
    assert _found(spark, same[:3]) == []  # at least four documents
    long = [("s", f"d{i}", "x" * 300_000 + "\nshared line here", "x", 1) for i in range(4)]
    assert {n for _, n in _found(spark, long)} == {1, 2}


def test_letter_case_alone(spark):
    """`Straße` and `strasse` differ in more than letter case."""
    rows = [("s", f"d{i}", "An der Straße" if i % 2 else "An der Strasse", "x", 1) for i in range(7)]
    assert {d for d, _ in _found(spark, rows)} == {f"d{i}" for i in (0, 2, 4, 6)}


def test_bands_bring_candidates(spark):
    """Lines of a cluster that only its bands tell of are counted too; the exact count then decides."""
    text = "the buyer alone must check whether this part is fit for the purpose and no claim of any kind follows from these "
    rows = [("s", f"d{i}", text + chr(97 + i) * 3) for i in range(8)]
    r = lines.Repeated(spark.createDataFrame(rows, "src string, doc string, text string"), "src", "doc", "text")
    assert r.lines().select("_doc").distinct().count() == 8 and r.found().count() == 0


def test_recall_of_near_lines(spark):
    """Planted variants of similarity 0.8 and more: at least 0.9 of the lines that brute force links are found."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    rows, want = [], set()
    for c in range(25):
        base = [word() for _ in range(40)]
        for d in range(5):
            own = list(base)
            for k in r.sample([0, 1, -1, -2, r.randrange(4, 36)], r.randint(1, 2)):
                own[k] = word()  # one to seven of 36 shingles differ from the base
            rows.append((f"s{c % 5}", f"d{c}-{d}", " ".join(own)))
    rows += [(f"s{i % 5}", f"e{i}", " ".join(word() for _ in range(30))) for i in range(40)]
    sets = [(s, d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)}) for s, d, t in rows for w in [t.split()]]
    near = lambda a, b: len(a & b) / len(a | b) >= 0.8
    for s in {x[0] for x in sets}:
        own = [x for x in sets if x[0] == s]
        group = {d: d for _, d, _ in own}
        for i, (_, d, a) in enumerate(own):
            for _, e, b in own[:i]:
                if near(a, b):
                    old, new = group[d], group[e]
                    group = {k: new if v == old else v for k, v in group.items()}
        sizes = defaultdict(set)
        for d, g in group.items():
            sizes[g].add(d)
        want |= {d for g in sizes.values() if len(g) >= 4 for d in g}
    got = {x["_doc"] for x in lines.Repeated(spark.createDataFrame(rows, "src string, doc string, text string"), "src", "doc", "text", share=0.0).near().collect()}
    assert len(want) > 20 and len(got & want) >= 0.9 * len(want) and got <= want


def test_text_without_lines(spark):
    df = spark.createDataFrame([("s", f"d{i}", f"Notice\nown {chr(97 + i)}\nNOTICE", 7) for i in range(5)], "src string, doc string, text string, _gone int")
    got = lines.without_lines(df, "doc", "text", lines.Repeated(df, "src", "doc", "text").found())
    assert {r["doc"]: r["text"] for r in got.collect()} == {f"d{i}": f"own {chr(97 + i)}" for i in range(5)}
    assert got.columns == df.columns
    many = "\n".join(f"line {k}" for k in range(30_000))
    df = spark.createDataFrame([("d", many), ("e", None), ("f", "")], "doc string, text string")
    gone = spark.range(1, 30_001, 2).selectExpr("'d' as _doc", "cast(id as int) as line_no")
    out = {r["doc"]: r["text"] for r in lines.without_lines(df, "doc", "text", gone).collect()}
    assert out["e"] is None and out["f"] == "" and out["d"].split("\n") == [f"line {k}" for k in range(1, 30_000, 2)]


def test_near_clusters(spark):
    words = "the buyer alone must check whether this part is fit for the purpose and no claim of any kind follows from these data or from samples sent before or after".split()
    rows = [("s", f"d{i}", " ".join([*words[:-1], f"x{chr(97 + i)}"]) + "\n" + " ".join(chr(97 + (i * 7 + k * k) % 26) * 3 for k in range(12)), 1) for i in range(8)]
    df = spark.createDataFrame(rows, "src string, doc string, text string, cluster int")
    r = lines.Repeated(df, "src", "doc", "text")
    assert r.found().count() == 0  # no two lines are the same
    got = r.near().collect()
    assert {(x["_doc"], x["line_no"]) for x in got} == {(f"d{i}", 1) for i in range(8)} and len({x["cluster"] for x in got}) == 1
    assert r.near().columns == ["_doc", "line_no", "cluster"]


def test_near_lines_share_a_bucket():
    """Pairs of five-word-shingle similarity 0.8 and more share a band."""
    r, hit, n = random.Random(5), 0, 200
    for _ in range(n):
        words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(60)]
        other = [*words[:-2], "zz", "yy"]  # 54 of 58 shingles in common
        bands, has, *_ = lines.hash_bands(" ".join(words) + "\n" + " ".join(other))
        assert has.all()
        hit += bool((bands[0] == bands[1]).any())
    assert hit >= 0.97 * n


def test_masks():
    bands, has, shingles, at = lines.hash_bands("Prepared in March 2024 by the desk of Acme today\nPrepared in April 19 by the desk of Other today\nshort one")
    assert has.tolist() == [True, True, False] and np.array_equal(bands[0], bands[1]) and at.tolist() == [0] * 5 + [1] * 5 and len(shingles) == 10
    k1, k2 = lines.hash_forms("Ab 1\nAB 23\n 4\n", True)
    assert k1[0] == k1[1] != 0 and k1[2] == 0 and k2[0] == k2[1]


def _drifting(n, step, docs):
    """Lines of n words; each has `step` other words than the one before."""
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}word" for i in range(n + step * docs)]
    return [("s", f"d{i}", " ".join(words[i * step : i * step + n]) + "\n" + " ".join(chr(97 + (i * 7 + k * k) % 26) * 3 for k in range(12))) for i in range(docs)]


def test_near_clusters_over_several_buckets(spark):
    """Neighbours are alike, the ends are not, and no bucket holds all of the lines: the union counts."""
    rows = _drifting(60, 3, 16)
    ids = lines._buckets([t.split("\n")[0] for _, _, t in rows], np.zeros(16, np.int64), True, False)[4][:, 1:]
    assert all((a == b).any() for a, b in zip(ids, ids[1:])) and np.unique(ids, return_counts=True)[1].max() < 14
    df = spark.createDataFrame(rows + [("s", f"e{i}", None) for i in range(40)], "src string, doc string, text string")  # 56 documents, 14 needed
    got = lines.Repeated(df, "src", "doc", "text").near().collect()
    assert {(x["_doc"], x["line_no"]) for x in got} == {(f"d{i}", 1) for i in range(16)} and len({x["cluster"] for x in got}) == 1


def test_near_holds_what_is_found(spark):
    df = spark.createDataFrame(_rows(), "src string, doc string, text string, _fh string, letter int")
    r = lines.Repeated(df, "src", "doc", "text")
    assert set(map(tuple, r.found().collect())) <= {(x["_doc"], x["line_no"]) for x in r.near().collect()}


def test_components(spark):
    r = random.Random(2)
    links = {(i + 1, i) for i in range(40)} | {tuple(sorted(r.sample(range(100, 160), 2), reverse=True)) for _ in range(40)}
    root = {n: n for x in links for n in x}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = lines.components(spark.createDataFrame(sorted(links), "a long, b long"))
    assert sorted(map(tuple, got.select("a", "b").collect())) == sorted((n, m) for n, m in root.items() if n != m)
    assert lines.components(spark.createDataFrame([], "a long, b long")).count() == 0
