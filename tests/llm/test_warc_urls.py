import gzip
import hashlib
import random

from runlake.llm import urls, warc
from runlake.session import work_dir


def archived(spark, frame, chunk_bytes=1000):
    path = work_dir(spark, "warc-test")
    warc.write_warc(frame, path, chunk_bytes=chunk_bytes)
    return path


def test_round_trip_in_chunks(ready, pages_of):
    tricky = ["\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "WARC/1.1\r\n", "\n", "\r\n\r\n", "x\n" * 700, "é" * 999 + "\n", "q" * 1000, "q" * 1001, "", None, "z" * 5000]
    frame = pages_of([(i, f"http://a/{i}", h) for i, h in enumerate(tricky)])
    payload, digests = {}, {}
    for r in warc.read_warc(ready, archived(ready, frame), chunk_bytes=333).orderBy("record_id", "chunk_no").collect():
        assert len(r["chunk"]) <= 333
        payload[r["record_id"]] = payload.get(r["record_id"], b"") + r["chunk"]
        assert r["payload_bytes"] == len(payload[r["record_id"]]) and r["payload_digest"] == hashlib.sha1(payload[r["record_id"]]).hexdigest()
        if r["last"]:
            digests[r["record_id"]] = (r["declared_digest"], r["declared_bytes"])
    for i, h in enumerate(tricky):
        b = (h or "").encode()
        assert payload[f"urn:page:{i}"] == b and digests[f"urn:page:{i}"] == (hashlib.sha1(b).hexdigest(), len(b))


def test_revisits(ready, pages_of):
    same, short = "s" * 1000, "t" * 999
    rows = [(1, None, same), (2, "http://a b\r\n", same), (3, "u", same), (3, "u", same), (None, None, same), (4, None, short), (5, None, short), (None, None, None)]
    found = warc.read_warc(ready, archived(ready, pages_of(rows)), with_chunks=False).where("last").collect()
    kinds = sorted(((r["record_id"], r["record_type"], r["refers_to"]) for r in found), key=str)
    assert kinds == sorted([
        ("urn:page:1", "revisit", "urn:page:3"), ("urn:page:2", "revisit", "urn:page:3"), ("urn:page:3", "response", None), ("urn:page:3", "response", None),
        ("urn:page:null", "revisit", "urn:page:3"), ("urn:page:4", "response", None), ("urn:page:5", "response", None), ("urn:page:null", "response", None),
    ], key=str)
    assert sum(r["record_type"] == "revisit" for r in found) == 3
    assert all(r["declared_bytes"] == 1000 for r in found if r["record_type"] == "revisit")
    assert warc.read_warc(ready, archived(ready, pages_of([]))).count() == 0


def test_foreign_archive(ready, tmp_path):
    """Records of other writers: no HTTP header, member by member, an unended record at the end."""
    block = b"GET / HTTP/1.1\r\n\r\n"
    record = lambda kind, body, more=b"": b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:x:" + kind + b">\r\n" + more + b"Content-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    with open(tmp_path / "a.warc.gz", "wb") as out:
        for r in (record(b"warcinfo", b"software: x\r\n"), record(b"request", block, b"Content-Type: application/http;msgtype=request\r\n"), record(b"resource", b"a\nb"), record(b"cut", b"12345")[:-6]):
            out.write(gzip.compress(r))
    found = {r["record_type"]: bytes(r["chunk"]) for r in warc.read_warc(ready, str(tmp_path)).collect()}
    assert found["warcinfo"] == b"software: x\r\n" and found["request"] == b"" and found["resource"] == b"a\nb" and found["cut"].startswith(b"123")


RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def plain(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    best = None
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best and best[0], best[1] if best else default


def test_urls_against_plain_rules(ready, pages_of, rows):
    r = random.Random(2)
    found_urls = [None, "", "no host", "http://", "HTTP://WWW.Example.COM/en/x?a#b", "http://example.com", "http://example.com?x/en/", "http://notexample.com/en/1", "a://b://net/es/",
                  "http://É.net/fr/é#", "http://net/es", "http://u@x.net:80/fr/", "http://a..com//"]
    found_urls += [f"http://{r.choice(['www.', 'm.', ''])}{r.choice(['example', 'x'])}.{r.choice(['com', 'net', 'org'])}/{r.choice(['en', 'es', 'fr'])}/{i}" for i in range(200)]
    frame = pages_of([(i, u, None) for i, u in enumerate([*found_urls, *found_urls[:3]])])
    found = rows(urls.judged(ready, frame, RULES), "page_id", "host", "path", "rule", "verdict")
    assert found == sorted(((i, *plain(u, RULES)) for i, u in enumerate([*found_urls, *found_urls[:3]])), key=repr)
    assert urls.judged(ready, pages_of([]), RULES).count() == 0
    assert rows(urls.judged(ready, frame.limit(1), []), "verdict", "rule") == [("allow", None)]


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda b: len(b) % 2)
    urls.write_rules([("a.com/", "block"), ("b.com/x", "allow"), ("c.com/", "block")], str(tmp_path / "r"))
    index = urls.Rules(str(tmp_path / "r"))
    assert index.find(["b.com", "c.com", "d.com", "x.a.com"], ["/xy", "/", "/", "/q"]) == [("b.com/x", "allow"), ("c.com/", "block"), (None, None), ("a.com/", "block")]
