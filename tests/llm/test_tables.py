"""License scans, url filters and the fixity audit: hand-made cases; their SQL runs in test_queries."""

import hashlib
import re

from pyspark.sql import functions as F

from assayloom.llm import license_scans as L
from assayloom.llm import url_filters as U
from assayloom.llm import warc_fixity as W
from assayloom.llm._shared import written


def brute(text):
    w = [x for x in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    places = [(i, label) for phrase, label in L.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_phrases_equal_brute_force_and_blocks_meet_templates(make_docs):
    texts = [
        "Released under the MIT License.",
        "mit license mit license-MIT  License",
        "xmit license mit licenses été apache\nlicense general public, license",
        "MİT license mit licenſe",
        None,
        "",
        "...",
        "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files,\nto deal in the Software without restriction\n\nother words",
        "under the released license of mit things",
        "this is released to the public under some license of ours",
        "Licensed under CC BY-NC 4.0.",
    ]
    got = {r["doc_id"]: r for r in L.license_scans(make_docs(texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), t
    assert [got[i]["labels"] for i in (0, 7, 8, 9, 10)] == ["mit", "mit", "mit", "", "cc"]
    assert got[0]["score"] == 1.0 and got[9]["score"] == 0.0


def hits(docs):
    vocabulary = sorted({w for _, t in L.TEMPLATES for w in L.template_words(t)})
    base = written(L.base_columns(docs, "doc_id", "text", vocabulary), "base")
    return L.template_hits(docs, base, "doc_id", "text").collect()


def test_license_hits_equal_all_pairs(make_docs, words):
    import random

    rng = random.Random(3)
    vocabulary = sorted({w for _, t in L.TEMPLATES for w in L.template_words(t)})
    texts = []
    for k in range(150):
        own = L.template_words(rng.choice(L.TEMPLATES)[1])
        own = [w for w in own if rng.random() < 0.95] + rng.sample(vocabulary, 3) + ["other"]
        rng.shuffle(own)
        texts.append(" ".join([*words(k, k % 40).split(), *own, *words(k + 1, k % 70).split()]))
    got = {(r["doc_id"], r["run"], r["start"], r["label"], round(r["containment"], 9)) for r in hits(make_docs(texts))}
    expected = set()
    for i, b in enumerate(texts):
        all_ = [w for w in re.split(L.SEPARATORS, b.translate(str.maketrans(L.UPPER, L.LOWER))) if w]
        for label, t in L.TEMPLATES:
            own, run = set(L.template_words(t)), L.run_of(t)
            for start in range(0, len(all_), run // 2):
                share = len(own & set(all_[start : start + run])) / len(own)
                if share >= L.THRESHOLD - 1e-12:
                    expected.add((i, run, start, label, round(share, 9)))
    assert got == expected and len(got) > 40


def test_a_notice_is_found_wherever_it_is_wrapped(make_docs, words):
    """Over lines of any width, with comment marks, in texts with and without blank lines, short and of 20,000 words."""
    texts, labels = [], []
    for k, (label, notice) in enumerate(L.TEMPLATES):
        w = notice.split()
        for width, mark, before in ((4, " ", 0), (7, " * ", 3000), (9, "# ", 300 + k), (60, "", 20_000 if k % 9 == 0 else 450 + k)):
            lines = [mark + " ".join(w[i : i + width]) for i in range(0, len(w), width)]
            texts.append("\n".join([words(k, before), *lines, words(k + 1, before // 2)] if width != 60 else [words(k, before) + " " + " ".join(lines)]))
            labels.append(label)
    got = {r["doc_id"]: r for r in L.license_scans(make_docs(texts)).collect()}
    assert all(label in got[i]["labels"].split(",") and got[i]["score"] == 1.0 for i, label in enumerate(labels))


def test_odd_license_rows(spark, odd_docs, no_docs):
    assert L.license_scans(odd_docs).count() == 11 and L.license_scans(no_docs).count() == 0
    docs = spark.createDataFrame([(1, "Released under the MIT License"), (1, "none"), (None, "Released under the MIT License"), (None, None)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["labels"]) for r in L.license_scans(docs).collect()) == [("1", ""), ("1", "mit"), ("None", ""), ("None", "mit")]


def test_rules_and_hosts(spark):
    urls = ["http://Sub.Example.ORG/es/1?x", "https://example.org/en/12", "https://example.org/fr", "https://example.org", "http://a.com/de/", "http://a.com/fr/x", "http://notexample.net/es/", "HTTP://X.com?q", "no scheme", None, "http://", "http://b.org/en/1://c"]
    pages = spark.createDataFrame([(i, u, "h", "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, bad string, quality string")
    labels = spark.createDataFrame([(6, 0, None, 1), (6, 0, 1, 1), (None, 0, 0, 1), (7, None, None, 1), (2, 1, 0, 1), (5, 1, None, 1), (0, None, 0, 1), (4, 1, 0, 1)], "doc_id long, quality int, toxic int, host int")
    got = {r["page_id"]: tuple(r)[1:5] for r in U.url_filters(pages, labels).collect()}
    assert got[0] == ("sub.example.org", "/es/1", "example.org/es/", "block")
    assert got[1][2:] == ("example.org/en/1", "block") and got[2][2:] == ("org/", "allow")
    assert got[3] == ("example.org", "", None, "allow")
    assert got[4][2:] == ("com/de/", "block") and got[5][2:] == ("com/fr/", "allow")
    assert got[7][:2] == ("x.com", "") and got[8] == got[9] == ("", "", None, "allow") and got[10][:2] == ("", "")
    assert got[11][:2] == ("b.org", "/en/1://c")
    assert U.url_filters(pages.where("page_id < 0"), labels).count() == 0
    assert U.url_filters(pages, labels.where("doc_id < 0")).where("verdict = 'block'").count() == 3


def test_reputation_blocks_bad_hosts_and_shrinks_small_ones(spark):
    rows = [(f"good{i}.site{i}.net", 0) for i in range(50) for _ in range(10)] + [("bad.evil.com", 1)] * 40 + [("new.site1.net", 1)]
    out = spark.createDataFrame(rows, "host string, bad int")
    r = {x["host"]: x for x in U.host_reputation(out, out.select("host").distinct()).collect()}
    assert r["bad.evil.com"]["bound"] > U.MAX_BAD > r["new.site1.net"]["bound"]
    assert 0 < r["good3.site3.net"]["mean"] < 0.1


def test_domains_of_ports_users_addresses_and_given_suffixes(spark):
    cases = {"a.b.com:8080": ("b.com", "com"), "u:p@x.co.uk": ("x.co.uk", "co.uk"), "1.2.3.4": ("1.2.3.4", "1.2.3.4"), "1.2.3.4:80": ("1.2.3.4", "1.2.3.4"), "[::1]:443": ("[::1]", "[::1]"), "": ("", ""), "x.y.github.io": ("github.io", "io"), "localhost": ("localhost", "localhost")}
    hosts = spark.createDataFrame([(h,) for h in cases], "host string")
    got = {r[0]: (r[1], r[2]) for r in hosts.select("host", *U.domain_columns(F.col("host"))).collect()}
    assert got == cases
    assert hosts.where("host = 'x.y.github.io'").select(*U.domain_columns(F.col("host"), ("github.io",))).first()[:] == ("y.github.io", "github.io")


def laid(rows, files):
    """Records by file, id and digest, one by one, with their offsets."""
    out, at = {}, {}
    for page, url, html in rows:
        page, url, html = -1 if page is None else page, url or "", html or ""
        body = html.encode()
        record = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{page}>\r\nWARC-Target-URI: {url}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
        out.setdefault(page % files, []).append((page, hashlib.sha256(record).hexdigest(), len(record)))
    for f, rs in out.items():
        no = end = 0
        for page, digest, size in sorted(rs):
            first = at.get((f, page, digest), (no, end))  # equal records of one id are one leaf
            at[f, page, digest] = (*first[:2], end + size)
            no, end = no + 1, end + size
    return at


def compared(spark, before, after, file_bytes, **how):
    schema = "page_id long, url string, html string, file string, place string"
    a, b = (W.hashed(W.records(spark.createDataFrame([(*r, "x", "y") for r in rows], schema))) for rows in (before, after))
    found = W.audit(*W.trees(a, b, file_bytes, **how)).collect()
    files = max(1, -(-(a.agg(F.sum(F.col("size") * F.col("times"))).first()[0] or 0) // file_bytes))
    x, y = laid(before, files), laid(after, files)
    for r in found if "crowd" not in how else []:  # shards have an order of their own
        if r["expected"]:
            assert (r["record_no"], r["start"], r["end"]) == x[r["file"], r["page_id"], r["expected"]]
        if r["found"]:
            assert (r["found_start"], r["found_end"]) == y[r["file"], r["page_id"], r["found"]][1:]
    return sorted((r["page_id"], r["kind"]) for r in found)


def test_audit_finds_exactly_the_damage(spark):
    rows = [(i, f"http://x/{i}", "body %d é" % i) for i in range(3000)]
    now = list(rows)
    now[5] = (5, rows[5][1], "BODY")
    now[777] = (777, rows[777][1], rows[777][2] + " and more")
    now[2999] = (2999, rows[2999][1], "")
    del now[1234]
    now += [(40, "http://x/40", "once more"), (4000, "http://x/4000", "new")]
    assert compared(spark, rows, now, 200_000) == [(5, "changed"), (40, "added"), (777, "changed"), (1234, "lost"), (2999, "changed"), (4000, "added")]
    assert compared(spark, rows, rows[::-1], 200_000) == []


def test_audit_of_many_records_of_one_id(spark):
    rows = [(None, f"u{i}", "x" * (i % 7)) for i in range(500)] + [(7, "u", "same")] * 300 + [(i, "v", "z") for i in range(20, 60)]
    now = [r for r in rows if r[1] not in ("u3", "u400")] + [(None, "u999", "w")]
    assert compared(spark, rows, now, 1 << 24, fan_in=4, crowd=8) == [(-1, "added"), (-1, "lost"), (-1, "lost")]
    assert compared(spark, rows, rows[:-1], 1 << 24, fan_in=4, crowd=8) == [(59, "lost")]


def test_audit_of_missing_odd_and_no_records(spark):
    rows = [(0, None, None), (1, "u", None), (None, "u", "x"), (2, "u", ""), (3, "u", "same"), (3, "u", "same"), (4, "u", "y" * 100_000)]
    assert compared(spark, rows, rows, 1 << 24) == []
    assert compared(spark, rows, rows[:-1], 1 << 24) == [(4, "lost")]
    assert compared(spark, rows, [r for k, r in enumerate(rows) if k != 5], 1 << 24) == [(3, "changed")]  # once instead of twice
    assert compared(spark, [], [], 1 << 24) == [] and len(compared(spark, rows, [], 1 << 24)) == 6
