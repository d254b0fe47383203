"""Merkle manifest, personal data and phrases against brute force on small tables with nulls, empty texts, ties and repeated rows."""

import glob
import hashlib
import os
import random
import re
import sys
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import collocations, merkle, pii, registry

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from test_queries import SF, rows  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, data, **more):
    df = spark.createDataFrame(data, DOCS)
    return df.select("*", *(F.lit(v).alias(k) for k, v in more.items()))


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], r[1])))


def whole_tree(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def whole_root(by_source):
    tops = [whole_tree(by_source[s])[-1][0] for s in sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))]
    return whole_tree(tops)[-1][0]


@pytest.mark.parametrize("depth", [1, 2, 7])
def test_versions_are_trees_built_anew(spark, depth):
    """Many tiers (depth 1), and one: each version's root is that of a tree built from all leaves, one changed; sources of 1, 2, 3, 4 and 40 rows, one null."""
    rng = random.Random(depth)
    data = [(i, f"line {i}\nmore\n" if i % 3 else "no feed", "en" if i % 4 else None, rng.choice(["a", "a", "a", "é", "zz", None]), i if i % 5 else None) for i in range(60)]
    data += [(100, "x\n", "en", "one", 2), (102, "y\ny", "en", "two", 3), (103, None, "en", "two", 0), (104, "", None, "two", 0), (None, "t\n", "en", "a", 2), (5, "tie\n", "en", "a", 4), (5, "tie\n", "en", "a", 4)]
    docs = table(spark, data, g="clash", i=1, n=2, leaf="x", part=3)
    got = merkle.proved(merkle.versions(docs, merkle.without_line_feeds(docs), depth)).collect()
    order = {s: sorted((r for r in data if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for s in {r[3] for r in data}}
    leaves = {s: [leaf_of(r) for r in of] for s, of in order.items()}
    root = whole_root(leaves)
    assert len(got) == len(data)
    assert sorted((str(r.g), r.i, r.doc_id, r.leaf) for r in got if r.doc_id is not None) == sorted((str(s), k, r[0], leaf_of(r)) for s, of in order.items() for k, r in enumerate(of) if r[0] is not None)
    nodes = {s: whole_tree(x) for s, x in leaves.items()}
    for r in got:
        assert r.root == root and r.subroot == nodes[r.g][-1][0]
        row = order[r.g][r.i]
        changed = list(row)
        if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[1]:
            changed[1] = row[1].replace("\n", "")
        now = {s: [leaf_of(changed) if (s, k) == (r.g, r.i) else x for k, x in enumerate(of)] for s, of in leaves.items()}
        assert r.folded_root == whole_root(now)
        assert r.verified == (tuple(changed) == row)
        assert r.proof_sha256 == sha(*(s.left + s.right for s in r.siblings))
        anew = whole_tree(now[r.g])
        place = r.i
        for level, d in enumerate(r.copies[: len(anew) - 1]):  # the copied ancestors are those of the tree built anew
            place //= 3
            assert d == anew[level + 1][place]
        assert bool(r.copies) == (tuple(changed) != row)
    copied = merkle.copied_nodes(merkle.versions(docs, merkle.without_line_feeds(docs), depth)).collect()
    assert len(copied) == sum(len(r.copies) + 1 for r in got if r.changed)


def test_manifest_of_little(spark):
    assert merkle.versions(table(spark, [])).collect() == []
    (one,) = merkle.proved(merkle.versions(table(spark, [(1, "a\nb", "en", "s", 3)]))).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == sha("") and one.siblings == []
    two = table(spark, [(2, "a\nb", "en", "s", 3)])  # crc32 of 2 is odd or even: both ways a tree of one leaf
    (r,) = merkle.proved(merkle.versions(two, F.lit("ab"))).collect()
    assert r.folded_root == leaf_of((2, "ab", "en", "s", 3)) and not r.verified


def literal(pattern, text):
    return [m.span() for m in re.finditer(pattern, text)]


def luhn_ok(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def base_by_hand(text):
    """The base kinds by their patterns as they are written down."""
    out = [("email", a, b) for a, b in literal(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", a, b) for a, b in literal(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in text[a:b].split("."))]
    for a, b in literal(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", text[a:b])
        out += [("card", a, b)] if 12 <= len(d) <= 19 and luhn_ok(d) else []
    out += [("phone", a, b) for a, b in literal(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"[^0-9]", "", text[a:b])) <= 15]
    return sorted(out, key=lambda x: (x[1], ["email", "ip", "card", "phone"].index(x[0])))


PARTS = ["a.b", "@", "mail@x.org", "x@y", "_", "1.2.3.4", ".", "256.1.1.1", "010.020.030.040.5.6.7.8", "4111 1111 1111 1111", "5500-0000-0000-0004", "4111111111111111", "+1 (555) 123-4567", "+", "(", ")", "-", " ", "  ", "\n", "é", "日本", "😀", "12", "007", "+49 30 901820", "tel ", "word", "00000000000000000000", "Á@b.c", "%+-@-.-"]


def test_base_spans_of_generated_texts():
    rng = random.Random(12)
    for _ in range(6000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        got = pii.spans(text)
        assert [(s.kind, s.start, s.end) for s in got if s.base] == base_by_hand(text), text
        own = [(s.start, s.end) for s in got if s.base]
        free = sorted((s.start, s.end) for s in got if not s.base)
        assert all(b <= c for (_, b), (c, _) in zip(free, free[1:], strict=False)) and not any(a < d and c < b for a, b in free for c, d in own)


FOUND = [
    ("pay to DE89 3704 0044 0532 0130 00 today", ["iban:DE89 3704 0044 0532 0130 00"]), ("pay to DE89 3704 0044 0532 0130 01 today", []), ("IBAN GB29NWBK60161331926819.", ["iban:GB29NWBK60161331926819"]),
    ("Tel. (030) 901 820 33", ["phone:(030) 901 820 33"]), ("order (030) 901 820 33", []), ("her SSN is 123-45-6789", ["ssn:123-45-6789"]), ("part 123-45-6789", []), ("social security 000-45-6789", []),
    ("ann.lee [at] mail [dot] example [dot] org", ["email:ann.lee [at] mail [dot] example [dot] org"]), ("from 2001:0db8:85a3:0000:0000:8a2e:0370:7334 on", ["ipv6:2001:0db8:85a3:0000:0000:8a2e:0370:7334"]), ("std::vector at 12:30:45", []),
    ("7536784127813050 4111111111111111", ["card:4111111111111111"]), ("4111 1111 1111 1111 5500 0000 0000 0004", ["card:4111 1111 1111 1111", "card:5500 0000 0000 0004"]), ("nothing at all here, 12 of 30 in 2024-05-06", []), ("", []),
]


@pytest.mark.parametrize(("text", "want"), FOUND)
def test_further_spans(text, want):
    assert [f"{s.kind}:{text[s.start : s.end]}" for s in pii.spans(text)] == want


def test_checks():
    assert [pii.luhn(d) == luhn_ok(d) for d in map(str, range(10**12, 10**12 + 200))] == [True] * 200
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")


def test_words_nearby_adjust_the_score():
    score = lambda t: pii.spans(t)[0].score
    assert score("my card 4111 1111 1111 1111") > score("a thing 4111 1111 1111 1111") > score("order 4111 1111 1111 1111")


def test_personal_data_of_rows(spark):
    data = [(1, "a@b.org and 1.2.3.4", "en", "s", 0), (1, None, None, None, None), (None, "", "en", "s", 0), (2, "+1 (555) 123-4567", "en", "s", 0), (2, "+1 (555) 123-4567", "en", "s", 0)]
    docs = table(spark, data, spans="clash", base=1, every=2)
    got = pii.find(docs).collect()
    assert len(got) == 5 and sum(r.n_email for r in got) == 1 and sum(r.n_phone for r in got) == 2
    assert {r.every for r in got} == {"email:0:7,ip:12:19", "", "phone:0:17"}
    marked = pii.redact(docs).collect()
    assert sorted(str(r.text) for r in marked) == sorted(["[EMAIL] and [IP]", "None", "", "[PHONE]", "[PHONE]"]) and marked[0].spans == "clash"
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in marked)
    assert pii.find(table(spark, [])).collect() == []


def test_long_runs_take_linear_time():
    for text in ("x" * 2_000_000, "1" * 2_000_000, "1 " * 1_000_000, "1." * 1_000_000, "+1" * 1_000_000, "a@" * 1_000_000, "+1" + "(" * 2_000_000, "ab" * 1_000_000 + "@", "@" + "ab" * 1_000_000, "f:" * 1_000_000):
        pii.spans(text)


def phrases_by_hand(data, longest=5, least=100, most=2000, contained=100):
    counts = {}
    for _, text, lang, _, _ in data:
        c = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            c.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        found = {p: v for p, v in c.items() if len(p) > 1 and v >= least}
        gone = {p[i : i + k] for p, v in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * v >= contained * c[p[i : i + k]]}
        best = [(min((1000 * a * n // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p))), a, " ".join(p)) for p, a in found.items() if p not in gone]
        best.sort(key=lambda x: (-x[0][0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, x[2], x[3], n, x[0]) for i, (x, a, p) in enumerate(best[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize(("bits", "least", "most"), [(64, 20, 2000), (10, 20, 2000), (6, 30, 5)])
def test_phrases(spark, bits, least, most):
    """With fingerprints of 10 and 6 bits most phrases collide, and the result is the same."""
    rng = random.Random(13)
    words = ["the", "of", "New", "YORK", "city", "é", "naïve", "Ä", "x\tand", "it's", "…", " ", "a_b"]
    data = [(i, "".join(rng.choices(words, weights=range(len(words), 0, -1))[0] + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", " \x0b"]) for _ in range(rng.randint(0, 90))), rng.choice(["en", "fr", None, "und"]), "s", 0) for i in range(120)]
    data += [(None, "the city of New York " * 200, "en", "s", 0), (7, None, "en", "s", 0), (7, "", "de", "s", 0), (8, "the city of new york " * 200, "en", "s", 0), (8, "the city of new york " * 200, "en", "s", 0)]
    got = collocations.collocations(table(spark, data, row="clash", key=1, n=2), 5, least, most, bits=bits).collect()
    assert sorted(tuple(r) for r in got) == phrases_by_hand(data, 5, least, most)


def test_phrases_of_cut_texts(spark, monkeypatch):
    """Buffers of a few bytes: long texts are cut where pieces end, and no phrase is lost."""
    monkeypatch.setattr(collocations, "BYTES", 64)
    test_phrases(spark, 64, 20, 2000)


def test_phrases_of_nothing(spark):
    assert collocations.collocations(table(spark, [])).collect() == []
    assert collocations.collocations(table(spark, [(1, None, None, None, None), (2, "a b", "en", "s", 3)])).collect() == []


def test_bitmaps_hold_all_members(spark):
    values = [random.Random(1).getrandbits(64) - (1 << 63) for _ in range(1000)]
    held = collocations.bitmap(spark.createDataFrame([(v,) for v in values], "v long"))
    assert all(v in held for v in values) and sum((v ^ (1 << 62)) in held for v in values) < 200


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_collocations"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    mine, theirs = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLES[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine.columns, mine.collect()) == rows(theirs.columns, theirs.fetchall())
