"""Hard negatives, archives and prefix tries against brute force and SQL, and their edge cases."""

from __future__ import annotations

import gzip
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cohortlens.llm import hard_negatives, prefix_trie, queries, warc
from harness import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_warc", "op13_prefix_trie"])
def test_query_equals_sql(spark, name):
    out = compare(spark, duck(SF), name, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)
    assert out["match"] and out["spark_rows"], out


# --- hard negatives -----------------------------------------------------------

def brute_negatives(rows, positives=5, negatives=3):
    """Sorted result rows of ``(vec_id, label, anchor, ints)`` tuples."""
    use = [r for r in rows if r[1] is not None and r[3] is not None and None not in r[3]]
    out = []
    for i, (anchor_id, label, anchor, vec) in enumerate(use):
        if not anchor:
            continue
        scored = sorted((-sum(a * b for a, b in zip(vec, v)), n is None, n or 0, same == label)
                        for j, (n, same, _, v) in enumerate(use) if j != i)
        for s, no_id, pos, _ in [x for x in scored if x[3]][:positives]:
            fit = [x for x in scored if not x[3] and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(anchor_id, None if no_id else pos, k, None if x[1] else x[2], -s, -x[0]) for k, x in enumerate(fit, 1)]
    return sorted(out, key=repr)


NEGATIVE_COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id bigint, label int, anchor boolean, ints array<bigint>, cell int")
    return sorted((tuple(r) for r in hard_negatives.mine(df, **more).select(*NEGATIVE_COLUMNS).collect()), key=repr)


def test_negatives_edges(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.randint(0, 2), i % 4 == 0, [rnd.randint(-3, 6) for _ in range(5)]) for i in range(60)]
    rows += [(8, 1, True, [1, 2, 3, 4, 5])] * 3  # repeated rows, an anchor among them
    rows += [(None, 2, False, [6] * 5), (None, None, True, [1] * 5), (101, 1, True, None), (102, 1, True, [1, None, 2, 3, 4]),
             (103, 0, True, [0] * 5), (104, 1, None, [0] * 5), (105, 2, True, []), (106, 2, True, [9, 9]), (107, 9, True, [1] * 5)]
    expected = brute_negatives(rows)
    assert expected and mined(spark, rows) == expected
    assert mined(spark, rows, levels=1) == expected
    assert mined(spark, []) == [] and mined(spark, [(1, 1, True, [])]) == []
    with pytest.raises(ValueError, match="fit a long"):
        mined(spark, [(1, 1, True, [1 << 40])])


def test_negatives_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 64)
    monkeypatch.setattr(hard_negatives, "CELL_ANCHORS", 8)
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 60, (4, 70))
    rows = [(i, int(i % 3 == 0) if i < 200 else int(rng.integers(5)), i % 11 == 0,
             [int(x) for x in centres[i % 4] + rng.normal(0, 25, 70)]) for i in range(400)]
    rows += [(1000 + i, 1, False, rows[0][3]) for i in range(200)]  # one vector and label hold a third
    assert mined(spark, rows) == brute_negatives(rows)


@pytest.mark.parametrize("dim", [1, 64, 100])
def test_intervals_hold_the_score(dim):
    rng = np.random.default_rng(dim)
    vectors = rng.integers(-300, 300, (200, dim))
    vectors[:3] = [[0], [1], [-300]]
    rotate = hard_negatives.Rotation(dim)
    turned = rotate(vectors)
    assert np.allclose(turned @ turned.T, vectors @ vectors.T)
    spreads = []
    for levels in (1, 2, 4):
        rows = object.__new__(hard_negatives.Rows)
        rows.codes, rows.aligns, rows.coded_norm, rows.rest = hard_negatives.sign_codes(turned, levels)
        rows.ones = np.bitwise_count(rows.codes).sum(axis=2, dtype=np.int64)
        low, high = hard_negatives.Query(turned).interval(slice(None), rows, np.arange(200))
        exact = vectors @ vectors.T
        assert (low <= exact).all() and (exact <= high).all()
        spreads.append((high - low).mean())
    assert spreads[0] > spreads[1] > spreads[2]


def test_intervals_leave_few_candidates(spark, monkeypatch):
    """Of the pairs of an anchor and a row few are scored in integers."""
    scored = []
    kept = hard_negatives._scores
    monkeypatch.setattr(hard_negatives, "_scores", lambda a, r, i, j: scored.append(len(i)) or kept(a, r, i, j))
    rng = np.random.default_rng(1)
    vectors = rng.normal(0, 32, (4000, 64)).round().astype(np.int64)
    rows = object.__new__(hard_negatives.Rows)
    rows.ints, rows.key, rows.id = vectors, np.arange(4000), np.arange(4000)
    rows.null_id = np.zeros(4000, bool)
    turned = hard_negatives.Rotation(64)(vectors)
    rows.codes, rows.aligns, rows.coded_norm, rows.rest = hard_negatives.sign_codes(turned)
    rows.ones = np.bitwise_count(rows.codes).sum(axis=2, dtype=np.int64)
    best, query = hard_negatives.Best(100, 5, rows), hard_negatives.Query(turned[:100])
    for i, j in hard_negatives._chunks(4000):
        of = np.arange(i, j)
        a, r = np.nonzero(query.interval(slice(None), rows, of)[1] >= best.least[:, None])
        best.add(a, of[r], hard_negatives._scores(vectors, vectors, a, of[r]))
    assert sum(scored) < 0.2 * 100 * 4000
    top = np.sort(vectors[:100] @ vectors.T, axis=1)[:, -5:]
    assert np.array_equal(np.sort(best.score.reshape(100, 5), axis=1), top)


# --- archives -----------------------------------------------------------------

PAGES = "page_id bigint, url string, html string, archive int"


def pages_of(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1) for r in rows], PAGES).repartition(parts)


def test_archives_edges(spark):
    big = "<p>é日本 body</p>" * 200
    rows = [(1, "http://a/ b", big), (2, None, big), (5, "http://c/é\n", big), (None, "http://d", big), (3, "u", None),
            (4, "", "short"), (6, "x", "short"), (7, "w", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 50),
            (8, "w", "\nhttp://x 0.0.0.0 1997 text/html 5\n" * 50), (5, "http://c", big), (9, "z", "A" * 999),
            (10, "z", "A" * 999), (11, "z", "A" * 1000), (12, "z", "A" * 1000), (13, "z", "q" * 3_000_000), (14, "", "")]
    for records in (2, 1000):
        got = warc.through_archives(pages_of(spark, rows), records).collect()
        assert len({r["record_id"] for r in got}) == len(rows)
        expected = []
        stands = {}
        for i, (page, _, html) in enumerate(rows):
            if html is not None and len(html.encode()) >= 1000:
                stands[html] = max(stands.get(html, (-1, 0)), (-1 if page is None else page, i))
        for i, (page, _, html) in enumerate(rows):
            raw = (html or "").encode()
            refers = stands[html][0] if html in stands and stands[html][1] != i else None
            expected.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "response" if refers is None else "revisit", refers))
        assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(expected, key=repr)
        assert {r["uri"] for r in got if r["page_id"] in (1, 2, 4)} == {"http://a/%20b", warc.NO_URL}
    assert warc.through_archives(pages_of(spark, [])).count() == 0


def archives(spark, path, kind):
    return [bytes(r["content"]) for r in warc._archives(spark, f"{path}/{kind}").orderBy("archive").collect()]


def test_archives_are_well_formed(spark, tmp_path):
    """Read by declared lengths alone, every file from its first byte to its last."""
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i * 7 % 400)) for i in range(25)] + [(99, "http://h/99", "<p>6</p>" * 42)] * 2
    warc.write_arc(pages_of(spark, rows, 2), f"{tmp_path}/arc", records=5)
    versions, seen = set(), 0
    for raw in archives(spark, tmp_path, "arc"):
        data = gzip.decompress(raw)
        assert data.startswith(b"filedesc://")
        for offset, fields, block in warc.arc_records(raw, "x"):
            assert data[offset:].split(b"\n", 1)[1].startswith(block)
            if "Offset" in fields:
                assert int(fields["Offset"]) == offset and fields["Result-code"] == "200"
            versions.add(fields.get("Version"))
            seen += not fields["URL"].startswith("filedesc://")
    assert versions == {"1", "2", None} and seen == 27
    index = warc.arc_index(spark, f"{tmp_path}/arc")
    warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc", warc.revisits(index, 200))
    kinds = defaultdict(int)
    for raw in archives(spark, tmp_path, "warc"):
        data, at, info = gzip.decompress(raw), 0, None
        while at < len(data):
            end = data.index(b"\r\n\r\n", at) + 4
            head = dict(line.split(b": ", 1) for line in data[at:end].strip().split(b"\r\n")[1:])
            n = int(head[b"Content-Length"])
            block = data[end:end + n]
            assert data[at:].startswith(b"WARC/1.1\r\n") and data[end + n:end + n + 4] == b"\r\n\r\n"
            kind = head[b"WARC-Type"].decode()
            kinds[kind] += 1
            if kind == "warcinfo":
                info = head[b"WARC-Record-ID"]
            else:
                assert head[b"WARC-Warcinfo-ID"] == info and head[b"WARC-Date"] == b"1997-01-01T00:00:00Z"
                assert head[b"WARC-Block-Digest"].decode() == warc.sha1_base32(block)
                assert kind != "revisit" or block.endswith(b"\r\n\r\n") and head[b"WARC-Profile"].endswith(b"identical-payload-digest")
            at = end + n + 4
    assert kinds["response"] + kinds["revisit"] == 27 and kinds["revisit"] >= 1 and kinds["warcinfo"] >= 6


def test_foreign_archives(spark, tmp_path):
    """Plain and per-record gzip archives of either version, foreign blocks and broken ones."""
    body = b"HTTP/1.0 200 OK\nContent-Length: 3\n\nabc"
    about = b"1 0 Some Crawler\n" + warc.ARC_FIELDS[1].encode() + b"\n\n"
    one = b"filedesc://old.arc 0.0.0.0 19960923142103 text/plain %d\n" % len(about) + about
    records = [b"http://a b/c 10.0.0.1 199609231421 text/html %d\n" % len(body) + body, b"dns:h 10.0.0.2 19960923142104 text/dns 4\nh A1"]
    plain = one + b"\n" + b"\n".join(records) + b"\n"
    zipped = gzip.compress(one) + b"".join(gzip.compress(b"\n" + r) for r in records)
    for raw in (plain, zipped):
        found = list(warc.arc_records(raw, "old"))
        assert [f["URL"] for _, f, _ in found] == ["filedesc://old.arc", "http://a b/c", "dns:h"] and found[1][2] == body
    two = b"http://q 10.0.0.1 19960923142103 text/html 404 - - 77 x.arc %d\n" % len(body) + body
    about = b"2 0 Some Crawler\n" + warc.ARC_FIELDS[2].encode() + b"\n"
    second = b"filedesc://x.arc 0.0.0.0 19960923142103 text/plain 200 - - 0 x.arc %d\n" % len(about) + about + b"\n" + two + b"\n"
    assert [f.get("Result-code") for _, f, _ in warc.arc_records(second, "x")] == [None, "404"]
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "part-1.arc").write_bytes(plain)
    (tmp_path / "arc" / "part-2.arc.gz").write_bytes(zipped)
    (tmp_path / "arc" / "part-3.arc").write_bytes(second)
    warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc", warc.revisits(warc.arc_index(spark, f"{tmp_path}/arc")))
    got = sorted((r["uri"], r["date"], r["payload_bytes"], r["page_id"]) for r in warc.read_warc(spark, f"{tmp_path}/warc").collect())
    assert got == [("http://a b/c", "1996-09-23T14:21:00Z", 3, None)] * 2 + [("http://q", "1996-09-23T14:21:03Z", 3, None)]
    kinds = [f["warc-type"] for raw in archives(spark, tmp_path, "warc") for f, _ in warc.warc_records(raw, "x")]
    assert kinds.count("resource") == 2 and kinds.count("warcinfo") == 3
    for broken in (plain[:-3], plain.replace(b"text/dns 4", b"text/dns x"), b"http://a 5\n12345\n"):
        with pytest.raises(warc.ArchiveError):
            list(warc.arc_records(broken, "x"))


# --- prefix trie --------------------------------------------------------------

def brute_trie(rows):
    """Sorted nodes of ``(conv_id, turn, role, text)`` tuples."""
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            code = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16] + len(text.encode()).to_bytes(4, "big")
            convs[c].append(((t is not None, t or 0, code), (role, text)))
    own = {c: [p for _, p in sorted(v)] for c, v in convs.items()}
    members, full = defaultdict(list), {}
    for c, v in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        full[c] = own.get(base, [])[:h] + v[h:]
        for d in range(len(full[c]) + 1):
            members[tuple(full[c][:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out, below = [], {}
    for k in sorted(members, key=len, reverse=True):
        own_saved = (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        below[k] = (sum(below[x][0] for x in kids[k]) if kids[k] else 1, own_saved + sum(below[x][1] for x in kids[k]))
        ends = ",".join(str(c) for c in sorted(members[k]) if len(full[c]) == len(k))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), *below[k],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, b"k") for r in rows], "conv_id bigint, turn bigint, role string, text string, path binary")


def nodes_of(df):
    return sorted((tuple(r) for r in df.select(*prefix_trie.NODES).collect()), key=repr)


@pytest.fixture(scope="module")
def odd_turns():
    rnd = random.Random(1)
    rows = [(c, t, rnd.choice(["u", "a", None]), rnd.choice(["x", "yé", "z", None])) for c in range(-20, 150) for t in range(rnd.randint(1, 6))]
    rows += [(1000 + i, t, "u", f"same {t}") for i in range(60) for t in range(90)]  # copies that fork behind 90 turns
    rows += [(1000 + i, 95, "u", f"fork {i % 7}") for i in range(0, 60, 2)]
    rows += [(None, 1, "u", "q"), (3, None, "u", "n"), (3, None, None, None), (3, 2, "b", "b"), (3, 2, "b", "b"), (4, 0, "u:", "x" * 100_000)]
    return rows


@pytest.mark.parametrize("limit", [1, 3, 20, 10 ** 6])
def test_trie_bursts(spark, odd_turns, limit, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_IDS", 4)
    assert nodes_of(prefix_trie.conversation_trie(turns_of(spark, odd_turns), limit)) == brute_trie(odd_turns)


def test_trie_edges(spark, odd_turns, monkeypatch):
    assert prefix_trie.conversation_trie(turns_of(spark, [])).count() == 0
    # 3 takes no turn of the absent 0 and has fewer turns than it skips: turnless, so the root is all
    alone = [(c, 0, "u", "x") for c in (1, 2, 3, 4) if zlib.crc32(str(c).encode()) % 9 > 0]
    assert alone and [n[:6] for n in nodes_of(prefix_trie.conversation_trie(turns_of(spark, alone)))] == \
        [(alone[0][0], 0, None, len(alone), 0, 1)]
    # records beyond the broadcast size, and lengths of repeated codes
    monkeypatch.setattr(prefix_trie, "BROADCAST_BYTES", 0)
    assert nodes_of(prefix_trie.conversation_trie(turns_of(spark, odd_turns).repartition(5), 2)) == brute_trie(odd_turns)
