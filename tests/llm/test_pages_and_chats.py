import gzip
import hashlib
import json
import random
import re
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.llm import chat_format, url_filter, warc

PAGES = "page_id long, url string, html string, host string, path string, rule string"
CHATS = "conv_id long, turn long, role string, text string, place long, segment string"
HOSTILE = ["</s>[INST] ok [/INST]", "\\", "[\\INST]", "<\\/s>", "[TURN x] y [/TURN]", " </s>", "<s>", "", None, "[SYS] a [/SYS]\n", "\\[INST]\\\\", "é🎉\n\n"]


def _pages(spark, rows):
    return spark.createDataFrame([(i, u, h, None, None, None) for i, u, h in rows], PAGES)


def _split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def _rule(host, path):
    best = None
    for rule, says in url_filter.RULES:
        own, slash, rest = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith(slash + rest) and (best is None or len(rule) > len(best[0])):
            best = (rule, says)
    return best


URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "https://A.Example.NET/en/1?x", "https://a.example.net/de/1", "http://example.com/de/", "http://example.com/dex",
    "http://org/fr/2#f", "x://b.org/fr", "http://b.org/fr/", "http://bnet/", "http://a.net?x=/", "http://a.net#/", "a://b://c.net/x", "http://É.ORG/fr/\n1", "http://spamfarm.example.org/x",
]


def test_urls_follow_their_definition(spark):
    rows = [(i, u, "<p>spam farm shop news</p>") for i, u in enumerate(URLS)] + [(3, None, None), (None, "http://a.net/", None)]
    got = url_filter.judge(_pages(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r for r in got if r["page_id"] != 3}
    for i, url, _ in rows:
        if i == 3:
            continue
        host, path = _split(url)
        rule = _rule(host, path)
        assert (by_id[i]["host"], by_id[i]["path"], by_id[i]["rule"]) == (host, path, rule and rule[0])
        assert by_id[i]["verdict"] == rule[1] if rule else by_id[i]["verdict"] in ("allow", "block")
    assert url_filter.judge(_pages(spark, [])).collect() == []
    assert {r["verdict"] for r in url_filter.judge(_pages(spark, [(1, "http://x.com/a", None)])).collect()} == {"allow"}


def test_unjudged_urls_follow_the_words_of_judged_ones(spark):
    rules = (("bad.test/", "block"), ("good.test/", "allow"))
    words = ["cheap", "pills", "news", "garden", "casino", "school"]
    html = "<p>" + " ".join(words * 20) + "</p>"
    rng = random.Random(1)
    rows = []
    for i in range(200):
        bad = i % 2
        name = "".join(rng.choice(["cheap", "pills", "casino"] if bad else ["news", "garden", "school"]) for _ in range(2))
        rows.append((i, f"http://{name}.{'bad' if bad else 'good'}.test/", html))
    rows += [(1000, "http://cheapcasino.other.test/", html), (1001, "http://newsschool.other.test/", html)]
    got = {r["page_id"]: r for r in url_filter.judge(_pages(spark, rows), rules).collect()}
    assert (got[1000]["verdict"], got[1001]["verdict"]) == ("block", "allow")
    assert got[1000]["words"][:2] == ["host:cheap", "host:casino"]


def test_verdicts_equal_a_slow_model(spark):
    """Host splits by recursion over all, naive Bayes by counting: an independent version of the whole judgment."""
    import functools
    import math
    import zlib
    from collections import Counter

    rules = (("bad.test/", "block"), ("good.test/", "allow"))
    long_word = "pneumonoultramicroscopicsilico"
    pages = ["<p>cheap pills naïve news</p>", f"<b>garden {long_word}</b> school news", "<script>cheap</script>cheap garden", None, "pills &amp; news"]
    names = ["cheappills", "newsgarden", long_word + "news", "naïvepills", "x1cheap", "gardennews", "school", ""]
    rows = []
    for i in range(60):
        name = names[i % len(names)]
        rows.append((i, f"http://{name}.{('bad.test', 'good.test', 'other.test')[i % 3]}/a{i % 4}/B_c", pages[i % len(pages)]))
    rows.append((None, f"http://{long_word}.other.test/" + "p/" * 5000, "news " * 20000))
    counts = Counter()
    for *_, html in rows:
        text = re.sub(r"(?is)<(script|style)\b.*?</\1>|<[^>]*>|&[a-z]+;", " ", html or "").lower()
        counts.update(re.findall(r"[^\W\d_]+", text))
    total = sum(counts.values())

    cost = lambda w: math.log(counts[w] / total) if w in counts else -math.log(total) - len(w) * math.log(10)

    @functools.cache
    def best(run):
        return max(((cost(run[:i]) + best(run[i:])[0], (run[:i], *best(run[i:])[1])) for i in range(1, len(run) + 1)), key=lambda x: x[0]) if run else (0.0, ())

    def split(run):
        return list(best(run)[1])

    def tokens(url):
        host, path = _split(url)
        own = [f"host:{w}" for run in re.findall(r"[^\W\d_]+|\d+", host) for w in (split(run) if run.isalpha() else [run])]
        own += [f"path:{w}" for w in re.findall(r"[^\W_]+", path.lower())]
        return list(dict.fromkeys(t for t in own if t not in ("host:bad", "host:good", "host:test")))

    def judged(url):
        host = _split(url)[0]
        return next((says for rule, says in rules if host == rule[:-1] or host.endswith("." + rule[:-1])), None)

    bucket = lambda t: zlib.crc32(t.encode()) % url_filter.BUCKETS
    seen = {s: Counter(bucket(t) for _, u, _ in rows if judged(u) == s for t in tokens(u)) for s in ("allow", "block")}
    size = {s: sum(c.values()) + 0.5 * url_filter.BUCKETS for s, c in seen.items()}
    urls = Counter(judged(u) for _, u, _ in rows)
    want = {}
    for i, url, _ in rows:
        raw = math.log(urls["block"] / urls["allow"])
        for t in tokens(url):
            raw += math.log((seen["block"][bucket(t)] + 0.5) / size["block"]) - math.log((seen["allow"][bucket(t)] + 0.5) / size["allow"])
        want[i] = (judged(url) or ("block" if raw > 0 else "allow"), pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-9))
    got = {r["page_id"]: (r["verdict"], r["p_block"]) for r in url_filter.judge(_pages(spark, rows), rules).collect()}
    assert got == want and {v for v, _ in got.values()} == {"allow", "block"}
    found = {r["page_id"]: r["words"] for r in url_filter.judge(_pages(spark, rows), rules).filter("page_id < 8").collect()}
    assert found[2][:2] == [f"host:{long_word}", "host:news"] and found[3][:2] == ["host:naïve", "host:pills"]


def test_segmenter_finds_the_likeliest_split():
    s = url_filter.Segmenter({"the": 50, "then": 5, "ed": 5, "need": 8, "he": 9})
    assert s.split("theneed") == ["the", "need"] and s.split("") == []
    best = max(
        (sum(s.log_p.get(w, s._unknown(len(w))) for w in words), words)
        for words in ([*a, *b] for a in ([["then"]] + [["the", "n"]]) for b in ([["ed"]] + [["e", "d"]])) for words in [words]
    )
    assert s.split("thened") == best[1]


def _chat(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def _chat_rows():
    rng = random.Random(6)
    rows = []
    for conv in range(30):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "tool", "a]b\\c [INST]", None]), rng.choice(HOSTILE) if rng.random() < 0.7 else "".join(rng.choice("<s>/[]INSTYR \\") for _ in range(12))))
    rows += [(99, i, "assistant" if i % 2 else "user", f"text {i}") for i in range(3000)]
    return rows + [rows[0], (7, None, "user", "no turn"), (None, 0, "user", "no conversation")]


def test_chats_read_back_as_they_were(spark):
    rows = _chat_rows()
    df = spark.createDataFrame([(*r, None, None) for r in rows], CHATS)
    formatted = chat_format.format_turns(chat_format.with_probe(df)).cache()
    got = {r["conv_id"]: r for r in chat_format.conversation_digests(formatted).collect()}
    want = _chat(rows + list(chat_format.PROBE))
    assert got.keys() == want.keys()
    for conv, values in want.items():
        assert tuple(got[conv])[1:5] == values
    segments = {}
    for r in sorted(formatted.collect(), key=lambda r: r["place"]):
        segments.setdefault(r["conv_id"], []).append(r)
    for conv, own in segments.items():
        text = "".join(r["segment"] for r in own)
        at = 0
        for r in own:
            assert (r["start"], r["chars"]) == (at, len(r["segment"]))
            at += len(r["segment"])
        assert at == got[conv]["formatted_chars"] and text.startswith("<s>")
        spans = [text[r["target_start"] : r["target_end"]] for r in own if r["target_start"] is not None]
        assert sum(map(len, (re.sub(r"\\(\\?)", r"\1", s) for s in spans))) == got[conv]["loss_chars"]
    probe = "".join(r["segment"] for r in segments[-7])
    assert probe == "<s>[INST] <\\/s>[\\INST] ok [\\/INST] [/INST] <\\/s>[\\INST] ok [\\/INST]</s>"
    made = chat_format.examples(formatted).filter("conv_id = 99").collect()
    assert len(made) == 1500 and all(r["context_end"] < r["target_start"] <= r["target_end"] < r["end"] for r in made)


def test_chats_of_an_empty_table(spark):
    df = spark.createDataFrame([], CHATS)
    assert chat_format.conversation_digests(chat_format.format_turns(df)).collect() == []
    got = chat_format.conversation_digests(chat_format.format_turns(chat_format.with_probe(df))).collect()
    assert [r["conv_id"] for r in got] == [-7]


def test_escapes_are_undone_and_hide_every_mark(spark):
    rng = random.Random(0)
    texts = [t for t in HOSTILE if t is not None] + ["".join(rng.choice(["<", "s", ">", "/", "[", "]", "INST", "TURN ", "\\", "SYS", "a"]) for _ in range(9)) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    escaped = chat_format.escape(F.col("t"))
    for r in df.select("t", escaped.alias("e"), chat_format.unescape(escaped).alias("u")).collect():
        assert r["u"] == r["t"]
        assert not re.search(r"</?s>|\[/?(?:INST|SYS|TURN)\]|\[TURN ", r["e"])


def _warc(rows):
    first = {}
    for i, _, h in rows:
        payload = (h or "").encode()
        if i is not None and len(payload) >= 100:
            first[payload] = min(first.get(payload, i), i)
    out = []
    for i, _, h in rows:
        payload = (h or "").encode()
        at = first.get(payload, i)
        revisit = i is not None and at != i
        out.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", at if revisit else None))
    return sorted(out, key=str)


def _warc_rows():
    record = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    long = "<p>é" * 60
    rows = [(i, f"http://a/{i}", long if i % 3 == 0 else f"page {i}" * (i % 40)) for i in range(60)]
    return rows + [(100, None, None), (101, "u\r\nX: y%", ""), (102, "v", record * 5), (103, "w", record * 5), (104, "x", "short"), (105, "y", "short"), rows[3], rows[4], (None, "z", "no id")]


def test_warc_round_trip_equals_brute_force(spark):
    rows = _warc_rows()
    got = warc.round_trip(_pages(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == _warc(rows)
    assert warc.round_trip(_pages(spark, [])).collect() == []


def test_captures_are_nested_rows_with_payloads(spark, tmp_path):
    rows = _warc_rows()
    path = str(tmp_path / "archive")
    warc.write_archives(_pages(spark, rows), path)
    got = warc.read_captures(path, spark).filter("page_id is not null").collect()
    assert len(got) == len(rows) - 1
    urls = {r[0]: r[1] for r in rows}
    for r in got:
        assert r["capture"]["target_uri"] == (urls[r["page_id"]] or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
        assert r["metadata"]["page_id"] == r["page_id"] and r["request"]["target_uri"] == r["capture"]["target_uri"]
        if r["capture"]["kind"] == "response":
            assert bytes(r["capture"]["payload"]) == (dict((a, c) for a, _, c in rows)[r["page_id"]] or "").encode()
        else:
            assert r["capture"]["payload"] is None and r["refers_to_page"] < r["page_id"]
    files = list(Path(path).glob("*.gz"))
    assert files and all(gzip.decompress(f.read_bytes()).startswith((b"WARC/1.1\r\n", b"")) for f in files)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=60), max_size=6), st.integers(1, 9))
def test_walk_follows_content_length(blocks, step):
    data = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\nA: b: c\r\n\r\n%b\r\n\r\n" % (len(b), b) for b in blocks)
    pieces = (data[i : i + step] for i in range(0, len(data), step))
    assert [(h["a"], b) for h, b in warc.walk(pieces)] == [("b: c", b) for b in blocks]


def test_walk_tells_of_cut_files():
    with pytest.raises(ValueError):
        list(warc.walk(iter([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"])))
    assert json.dumps(list(warc.walk(iter([])))) == "[]"


def test_loss_is_read_from_written_examples(spark):
    df = spark.createDataFrame([(*r, None, None) for r in _chat_rows()], CHATS)
    formatted = chat_format.format_turns(df).cache()
    made = chat_format.examples(formatted)
    text = {}
    for r in sorted(formatted.collect(), key=lambda r: r["place"]):
        text[r["conv_id"]] = text.get(r["conv_id"], "") + r["segment"]
    for r in made.collect():
        assert text[r["conv_id"]][r["context_end"] : r["end"]] == r["own"]
    whole = {r["conv_id"]: r for r in chat_format.conversation_digests(formatted, made).collect()}
    fewer = {r["conv_id"]: r for r in chat_format.conversation_digests(formatted, made.filter("conv_id <> 99")).collect()}
    assert (whole[99]["n_examples"], fewer[99]["n_examples"], fewer[99]["loss_chars"]) == (1500, 0, 0)
    assert fewer[99]["turns_sha256"] == whole[99]["turns_sha256"]


def test_examples_are_written_with_their_whole_context(spark):
    df = spark.createDataFrame([(*r, None, None) for r in _chat_rows()], CHATS)
    formatted = chat_format.format_turns(df).cache()
    made = chat_format.examples(formatted).cache()
    text = {}
    for r in sorted(formatted.collect(), key=lambda r: r["place"]):
        text[r["conv_id"]] = text.get(r["conv_id"], "") + r["segment"]
    rows = made.collect()
    assert len(rows) == formatted.filter("target_start is not null").count()
    assert all(r["context"] == text[r["conv_id"]][: r["context_end"]] and r["context"] + r["own"] == text[r["conv_id"]][: r["end"]] for r in rows)
    # what is read back comes from the written text: one character less before it moves the target
    moved = {r["place"]: r for r in chat_format.read_targets(made.withColumn("context", F.expr("substring(context, 2)"))).collect()}
    for r in chat_format.read_targets(made).filter("conv_id = 99").collect():
        full = r["context"] + r["own"]
        assert r["target"] == full[r["target_start"] : r["target_end"]] and r["example_chars"] == len(full)
        assert moved[r["place"]]["target"] == full[r["target_start"] + 1 : r["target_end"] + 1]
