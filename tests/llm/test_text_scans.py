import gzip
import hashlib
import io
import random
import re
import time
from collections import defaultdict

import pytest

from quillon.llm.decontaminate import NUMBER_WORDS, UNITS, contaminated, decontaminate, held_items
from quillon.llm.html_extract import extract, extract_text, learn
from quillon.llm.license_scan import TEMPLATES, license_scan
from quillon.llm.warc import arc_record, arc_start, archive_pages, convert_arc, pages_to_arc, parse_arc, parse_warc, read_warc, warc_record, with_record_types, write_warc

ITEM = "A train leaves London at 9 and travels 120 km with Maria aboard. After 3 hours Maria meets her friend, who walked 5 km from home. How far is it?"


def test_leaks_and_changed_questions(spark, docs, empty):
    other = ITEM.replace("120", "310").replace("Maria", "Oleg").replace("London", "Paris")
    torn = ITEM.replace("with Maria", "with Oleg")  # Maria becomes Oleg in one place only
    rows = [(1, f"Before. {ITEM} After."), (2, f"words before this {other} and words after"), (3, torn), (4, "A train leaves London."), (5, None), (6, ""), (7, ITEM.upper()), (None, ITEM)]
    bench = spark.createDataFrame([(10, ITEM), (11, None), (12, "short one")], "item_id long, text string")
    got = {(r.key if r.key < 100 else None): r for r in contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert {1, 2, 7, None} <= set(got) and not {4, 5, 6} & set(got)
    assert not got[1].reparameterised and got[2].reparameterised and got[1].coverage == 1
    assert decontaminate(docs, bench).count() == docs.count() and decontaminate(docs, bench).columns == docs.columns
    assert contaminated(empty, bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_short_and_number_heavy_items(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "Name the largest moon of Saturn"), (2, "12 + 7 - 3 km, 19 kg, 5 h: 31, 7, 8 Anna Boris 2 3 4"), (3, "Olaf Olsen Osaka Oslo 1 2 3"), (4, "What is the capital of the state in which 300 people live near the lake?")], "item_id long, text string")
    fill = " ".join(f"filler{i % 97} word" for i in range(40_000))
    rows = [
        (1, f"{fill} Name the largest moon of Saturn. {fill}"), (2, "so: 12 + 7 - 3 km, 19 kg, 5 h: 31, 7, 8 Anna Boris 2 3 4 it is"), (3, "x olaf olsen osaka oslo 1 2 3"), (4, "Name the largest moon"), (5, fill),
        (6, "he asked What is the capital of the state in which 450 people live near the lake?"), (7, "olaf olsen osaka oslo 1 2 4"), (1, f"{fill} Name the largest moon of Saturn. {fill}"), (8, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {(1, 1, False), (2, 2, False), (3, 3, False), (6, 4, True)}
    got = {(r.key, r.item, r.reparameterised) for r in contaminated(docs, bench).collect()}
    assert got == want
    monkeypatch.setattr("quillon.llm.decontaminate.BROADCAST_WINDOWS", 3)
    rows = contaminated(docs, bench).collect()
    assert {(r.key, r.item, r.reparameterised) for r in rows} == want and len(rows) == 4


def test_slots_match_both_ways(spark):
    item = "yesterday morning Anna gave Boris seven blue marbles near the old house before lunch with others"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item.replace("Anna", "Olga").replace("Boris", "Olga")), (2, item.replace("Anna", "Olga")), (3, item.replace("Anna", "Boris").replace("gave Boris", "gave Anna"))]
    assert {r.key for r in contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()} >= {2, 3}
    assert held_items([(1, 0, 20, 0, False, 0, 16, [5, 6], [7, 7])]) == [] != held_items([(1, 0, 20, 0, False, 0, 16, [5, 6], [7, 8])])


def test_decontaminate_with_its_own_names_as_columns(spark, docs):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    out = decontaminate(docs.selectExpr("*", "'x' as fp", "'y' as window", "'z' as item", "'t' as tokens", "'q' as same"), bench)
    assert {"key", "fp", "window", "item", "tokens", "same"} <= set(out.columns) and not {6, 14} & {r.doc_id for r in out.collect()}


def test_torn_slots_are_no_leak(spark):
    item = "Anna gave Anna seven blue marbles near where Anna had seen other marbles before lunch today by Anna herself"
    torn = item.replace("near where Anna", "near where Boris")
    bench = spark.createDataFrame([(1, "They say " + item)], "item_id long, text string")
    got = {r.key for r in contaminated(spark.createDataFrame([(1, "They say " + item.replace("Anna", "Olga")), (2, "They say " + torn)], "doc_id long, text string"), bench).collect()}
    assert got == {1}


TOKEN = re.compile(r"[A-Za-z0-9]+(?:(?<=\d)[.,](?=\d)[A-Za-z0-9]+)*")


def brute_template(text):
    """([(template, value)], [word]) of an ASCII text, token by token."""
    spans = [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(text)]
    out, kinds = [], []
    for i, (a, _, w) in enumerate(spans):
        before = text[spans[i - 1][1] : a] if i else "."
        opens, near = bool(re.search(r'[.!?\n:|"]', before)) or not i, before in (" ", "-")
        number = w[0].isdigit() or w.lower() in NUMBER_WORDS
        unit = not number and kinds[-1:] == ["number"] and w.lower() in UNITS
        capital = w[0].isupper() and len(w) > 1 and w[1:] == w[1:].lower() and not number and not unit
        kind = "number" if number else "unit" if unit else "name" if capital and not opens else "opener" if capital else "word"
        if kind == "name" and near and kinds[-1] in ("name", "opener"):
            if kinds[-1] == "opener":
                out[-1] = ("name", out[-1][1])
            out[-1] = ("name", (*out[-1][1], w.lower()))
        elif kind == "number" and not w[0].isdigit() and near and kinds[-1] == "number":
            out[-1] = ("number", (*out[-1][1], w.lower()))
        else:
            out.append((kind if kind in ("number", "unit", "name") else w.lower(), (w.lower(),)))
        kinds.append(kind)
    return out, [w.lower() for *_, w in spans]


def brute_leaks(docs, items):
    """(document, item) by comparing all places of all documents with all items, shift by shift."""
    slots, found = ("number", "name", "unit"), set()
    for d, text in docs:
        ours, our_words = brute_template(text)
        for i, item in items:
            theirs, words = brute_template(item)
            n, size = len(theirs), min(len(theirs), 8)
            run = min(13, len(words))
            if any(our_words[s : s + run] == words[o : o + run] for o in range(len(words) - run + 1) for s in range(len(our_words))):
                found.add((d, i))
            for shift in range(-n, len(ours)):
                for least in (3, 4):
                    hit, pairs = set(), set()
                    for at in range(n - size + 1):
                        a, b = theirs[at : at + size], ours[at + shift : at + shift + size] if at + shift >= 0 else []
                        if [x for x, _ in a] == [x for x, _ in b] and sum(x not in slots for x, _ in a) >= min(least, size):
                            hit |= set(range(at, at + size))
                            pairs |= {(x[1], y[1]) for x, y in zip(a, b, strict=True) if x[0] in slots}
                    enough = len(hit) == n if least == 3 else len(hit) >= 13 or len(hit) >= 0.6 * n
                    if hit and enough and len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs}):
                        found.add((d, i))
    return found


def test_changed_questions_equal_brute_force(spark, monkeypatch):
    r = random.Random(11)
    forms = [
        "A bus leaves {a} for {b} at {n} and {a} is {m} km from {b}, so when does it reach {b}?", "What is {n} plus {m}?", "{a} has {n} apples and gives {m} of them to {b}. How many apples does {a} keep?",
        "Yesterday {a} sold {n} kg of salt while {b} sold {m} kg of sugar near the old harbour of {a} at noon", "Compute {n} times {m}", "Is {n} larger than {m} or than the age of {a}?",
    ]
    names = ["Boston", "New York", "Los Angeles", "Chicago", "San Juan Capistrano", "Oslo", "Rio-Grande", "Maria", "Anna Lena"]
    numbers = ["15", "twenty-five", "3,200", "seven", "one hundred", "4.5", "3 million", "12"]

    def ask(form):
        (a, b), (n, m) = r.sample(names, 2), r.sample(numbers, 2)
        text = form.format(a=a, b=b, n=n, m=m)
        if r.random() < 0.25:  # torn: one place has another name
            text = text[::-1].replace(a[::-1], r.choice(names)[::-1], 1)[::-1]
        return text

    prose = lambda k: " ".join(r.choice(["the", "lamp", "of", "Oslo", "seven", "runs", "9", "km", "today", "What is", "over"]) for _ in range(k))
    items = [(i, ask(r.choice(forms))) for i in range(40)]
    rows = [(d, ". ".join([prose(r.randrange(30)), *(ask(r.choice(forms)) for _ in range(r.randrange(3))), prose(r.randrange(30))])) for d in range(120)]
    rows += [(200, "He asked: What is 31 plus 64? Nobody knew"), (201, "so many people ask what is left of plus")]
    items += [(100, "What is 15 plus 27?"), (101, "A bus leaves Boston at noon with fifteen apples on board and reaches Chicago in an hour")]
    rows += [(202, "We saw that. A bus leaves New York at noon with twelve apples on board and reaches Los Angeles in an hour.")]
    want = brute_leaks(rows, items)
    assert {(200, 100), (202, 101)} <= want and len(want) < len(rows) * len(items) / 2
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert {(x.key, x.item) for x in contaminated(docs, bench).collect()} == want
    monkeypatch.setattr("quillon.llm.decontaminate.BROADCAST_WINDOWS", 3)
    monkeypatch.setattr("quillon.llm.decontaminate.PART", 7)
    joined = [(x.key, x.item) for x in contaminated(docs, bench).collect()]
    assert set(joined) == want and len(joined) == len(want)


def brute_licenses(rows):
    """(id, license): (containment, places) by all windows of all size classes against all templates."""

    def shingles(t):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return [tuple(w[j : j + 5]) for j in range(len(w) - 4)]

    known = [(name, i, set(shingles(x))) for name, texts in TEMPLATES.items() for i, x in enumerate(texts)]
    size = {len(s): 1 << (len(s) - 1).bit_length() for *_, s in known}
    found = defaultdict(lambda: [0.0, set()])
    for key, text in rows:
        row = shingles(text)
        windows = defaultdict(dict)  # of the same shingles in the same order, whatever the class
        for c in set(size.values()):
            for at in range(0, max(len(row), 1), c):
                window = tuple(dict.fromkeys(row[at : at + 2 * c]))
                for name, i, s in known:
                    if size[len(s)] == c and (m := s & set(window)) and len(m) >= 0.8 * len(s):
                        windows[window][name, i] = (len(m) / len(s), m)
        for window, held in windows.items():
            for (name, _), (share, m) in held.items():
                if not any(o > share and m <= x for o, x in held.values()):
                    best = found[key, name]
                    best[0] = max(best[0], share)
                    best[1].add(window)
    return {k: (share, len(places)) for k, (share, places) in found.items()}


def test_license_scan_equals_brute_force(spark, docs, empty):
    r = random.Random(5)
    fill = [f"w{i}" for i in range(900)]
    rows = [(900, None), (901, ""), (902, " ".join(fill)), (903, "Released under the"), (904, "released under many different licenses"), (None, "Released under the MIT License.")]
    for n, (_, texts) in enumerate(TEMPLATES.items()):
        for k, t in enumerate(texts):
            w = t.upper().split() if k % 2 else t.split()
            for j in range(len(w)):
                if r.random() < (0.0, 0.02, 0.04)[k % 3]:
                    w[j] = "other"
            rows.append((10 * n + k, " ".join(fill[: r.randrange(60)] + w + fill[r.randrange(900) :])))
    rows += rows[-2:] + [(950, " ".join(fill * 30 + [t for texts in TEMPLATES.values() for t in texts] + fill * 20))]
    got = {(x.doc_id, x.license): (x.containment, x.places) for x in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_licenses(rows) and len(got) > 2 * len(TEMPLATES) and {i for i, _ in got} >= {None, 950}
    assert license_scan(docs.selectExpr("*", "1 as _id", "2 as _words", "3 as license")).count() == 0 and license_scan(empty).count() == 0


PAGE = "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>Menu one</a></li></ul></nav><div class=ad>Buy this now please</div><article><h1>Head &amp; more</h1><p>First  part\nof <b>text<br>goes on</p><p>Second part of it here.</article><footer>&copy; someone or other</footer></body></html>"


def test_extraction():
    weights = learn([PAGE])
    want = "Head & more\n\nFirst part of text goes on\n\nSecond part of it here."
    assert extract(PAGE, weights) == want
    inner = PAGE.replace("<p>Second", "<aside>Read also this</aside><form><input>Mail</form><!-- c --><div class='comments'>A comment of a reader</div><p>Second")
    assert extract(inner, weights) == want
    assert extract(PAGE.replace("</article>", "</article><!-- open"), weights) == want
    assert [extract(x, weights) for x in (None, "", "<", "<<<>", "<script>x", "<!--")][:2] == ["", ""]


def test_blocks_inside_an_article():
    weights = learn([PAGE])
    para = "<p>" + "Some words of it. " * 4 + "</p>"
    long = "<p>" + "Buy more things here, friends. " * 80 + "</p>"
    frame = "<html><body><nav><a href=/>Home</a></nav><article>{}</article><footer>Foot</footer></body></html>"
    want = "\n\n".join(["Some words of it. Some words of it. Some words of it. Some words of it."] * 2)
    for block in (f"<aside>{long}</aside>", f"<form>{long}</form>", f"<div class='comment-list'>{long}</div>", f"<section id=comments>{long}</section>", f"<div class=\"ad-banner\">{long}</div>"):
        assert extract(frame.format(para + block + para), weights) == want
    for kept in ('id="side-effects"', 'class="related-work"', "class=has-sidebar", "class='no-sidebar wide'"):
        assert extract(frame.format(f"{para}<section {kept}>{para}</section>"), weights) == want
    assert extract(f"<body><div class='sidebar content'><h1>Some words of it. {'Some words of it. ' * 3}</h1>{para}</div></body>", weights) == want
    assert extract(frame.format(f"<p>one <a href=it's>two</a> three</p><p>isn't</p>{para}{para}"), weights).startswith("one two three\n\nisn't\n\n")
    assert extract(frame.format(f"<p>{'x ' * 400_000}</p>"), weights) == " ".join("x" * 400_000)


def test_deep_nesting_is_linear():
    weights, took = learn([PAGE]), []
    for n in (4_000, 32_000):
        for page in ("<div>" * n + "deep words here" + "</div>" * n, "<b><p>" * n + "deep words here", "<p><i>" * n + "deep words here"):
            began = time.perf_counter()
            extract("<article>Text of it " + "words " * 9 * n + page, weights)
            took.append(time.perf_counter() - began)
    assert all(b < 30 * a + 0.5 for a, b in zip(took[:3], took[3:], strict=True))


def test_extract_text_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (None, "u", "", "z"), (3, "v", PAGE, "x"), (3, "v", PAGE, "x")], "page_id long, url string, html string, text string")
    out = {r.page_id: r for r in extract_text(pages, learn([PAGE])).collect()}
    assert out[1].n_chars == len(out[1].text) > 0 and out[2].text == "" == out[None].text
    assert extract_text(pages.limit(0), {}).count() == 0


def test_arc_by_declared_lengths():
    bodies = [b"plain", b"", b"http://x 0.0.0.0 20240101 text/html 3\nabc\n", "é\n\n".encode()]
    for version in (1, 2):
        blob = arc_start(version) + b"".join(arc_record(f"http://e.org/{i} b", b, version) for i, b in enumerate(bodies))
        got = list(parse_arc(blob))
        assert [b for _, b in got] == bodies and got[1][0]["URL"] == "http://e.org/1%20b"
        with pytest.raises(ValueError):
            list(parse_arc(blob[:-4]))


def test_foreign_archives(spark, tmp_path):
    records = [({"WARC-Type": "warcinfo"}, b"x"), ({"WARC-Type": "response", "Content-Type": "application/http", "WARC-Target-URI": "http://a"}, b"HTTP/1.1 200 OK\r\n\r\nbody\r\n\r\nWARC/1.0\r\n"), ({"WARC-Type": "resource", "WARC-Record-ID": "<urn:uuid:7>"}, bytes(range(256)))]
    parts = [warc_record(h, b) + b"\r\n\r\n" for h, b in records]
    (tmp_path / "plain.warc").write_bytes(b"".join(parts))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    got = [(r.record_type, r.url, r.payload_bytes, r.digest, r.whole, r.record_id) for r in read_warc(spark, str(tmp_path)).collect()]
    want = [("response", "http://a", 18, hashlib.sha1(b"body\r\n\r\nWARC/1.0\r\n").hexdigest(), True, None), ("resource", None, 256, hashlib.sha1(bytes(range(256))).hexdigest(), True, "7")]
    assert sorted(got, key=repr) == sorted(want * 2, key=repr)
    with pytest.raises(ValueError):
        list(parse_warc(io.BytesIO(parts[1][:-9])))


def test_archives_round_trip(spark):
    big, other = "é" * 600 + "\r\n\r\nWARC/1.1\r\n", "b" * 999
    rows = [(1, "http://a", big), (2, "http://b", big), (5, None, big), (3, "http://c d", other), (4, "x", other), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", "a" * 1000), (8, "u", "a" * 1000)]
    out = archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == len(rows) and all(r.whole for r in out)
    ids = {r.record_id: r.page_id for r in out if r.record_type == "response"}
    assert all(ids[r.refers_to_record] == r.refers_to for r in out if r.record_type == "revisit")
    by = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in out}
    size = len(big.encode())
    assert by == {1: ("revisit", 5, size), 2: ("revisit", 5, size), 5: ("response", None, size), 3: ("response", None, 999), 4: ("response", None, 999), 6: ("response", None, 0), 7: ("response", None, 0), None: ("response", None, size), 8: ("response", None, 1000)}
    assert archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_archives_end_at_a_size(spark, tmp_path):
    rows = [(i, f"http://e.org/{i}", "ü" * (2_000_000 if i == 7 else 300 + i)) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = str(tmp_path / "archives")
    write_warc(with_record_types(convert_arc(pages_to_arc(pages))).coalesce(2), path, archive_bytes=8_000)
    blobs = [gzip.decompress(f.read_bytes()) for f in (tmp_path / "archives").glob("*.gz")]
    found = [list(parse_warc(io.BytesIO(b))) for b in blobs if b]
    assert len(found) > 4 and all(records[0][0]["WARC-Type"] == "warcinfo" and len(records) > 1 for records in found)
    assert all(sum(len(block) for _, block in records[:-1]) < 8_000 for records in found)
    info = [{h["WARC-Warcinfo-ID"] for h, _ in records[1:] if "WARC-Warcinfo-ID" in h} <= {records[0][0]["WARC-Record-ID"]} for records in found]
    assert all(info)
    got = {r.page_id: r.payload_bytes for r in read_warc(spark, path).collect()}
    assert got == {i: len(t.encode()) for i, _, t in rows}
