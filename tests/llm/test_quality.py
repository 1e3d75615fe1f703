import re

from edge import clashing, documents, edge_rows

from linkspan.llm import quality

W = re.compile(r"[^\x20\x09-\x0D]+")


def name(*numbers):
    """A word of letters for some numbers: digits would all be alike once normalised."""
    return "x".join(str(n).translate(str.maketrans("0123456789", "abcdefghij")) for n in numbers)


def brute(rows):
    """Verdicts by the rules as they are written, over (uid, text, host)."""
    texts = [(t or "", h) for _, t, h in rows]
    norm = lambda s: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", "".join(c.lower() if "A" <= c <= "Z" else c for c in s))).strip(" ")
    by_host = {}
    for t, h in set(texts):
        by_host.setdefault(h, []).append({norm(x) for x in t.split("\n") if W.search(x)})
    common = {(h, x) for h, sets in by_host.items() for x in set().union(*sets) if sum(x in s for s in sets) > max(20, 0.02 * len(sets))}
    out = []
    for t, h in texts:
        words = W.findall(t)
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        held = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)} if len(grams) < 3000 else None
        lines = [x for x in t.split("\n") if W.search(x)]
        gone = sum(len(W.findall(x)) for x in lines if (h, norm(x)) in common)
        out.append((len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), held and len(held) or 0 if held is not None else None, gone))
    return out


def check(spark, rows):
    df = clashing(documents(spark, rows))
    got = {r.uid: r for r in quality.judge(df)[0].collect()}
    ordered = [got[k] for k in sorted(got)]
    for r, (words, chars, symbols, dups, repeats, gone) in zip(ordered, brute([(r[0], r[1], r[3] if len(r) > 3 else "src1") for r in rows]), strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.removed_words) == (words, chars, symbols, dups, gone)
        if repeats is None:
            continue
        assert r.n_repeat_words == repeats
        failed = words < 10 or 100 * repeats > 20 * words
        assert r.base_failed == failed and r.kept == (not failed and words - gone >= 10 and gone <= 0.8 * words)


def test_edges(spark):
    check(spark, edge_rows())


def test_common_lines_and_copies(spark):
    body = [" ".join(name(i, k) for k in range(30)) for i in range(60)]
    rows = [(i, f"Follow  us 2{i}\n{b}") for i, b in enumerate(body)]
    rows += [(100 + i, body[0]) for i in range(50)]  # copies of a clean text are clean
    rows += [(200, "follow us 7\nfollow us 8\nfollow us 9\nFOLLOW us 1\n" + body[1][:20])]
    rows += [(300 + i, f"Follow us 5\n{b}\nagain {b}", "en", "other") for i, b in enumerate(body[:5])]
    check(spark, rows)
    kept = {r.doc_id for r in quality.judge(documents(spark, rows))[0].where("kept").collect()}
    assert {100, 149, 0, 59} <= kept and 200 not in kept


def test_clean_strips_common_lines_and_keeps_columns(spark):
    rows = [(i, "Menu\n" + " ".join(name(i, k) for k in range(30)) + "\nMENU") for i in range(40)] + [(99, "too short")]
    df = clashing(documents(spark, rows))
    out = quality.clean(df)
    assert out.columns == df.columns and out.schema["n_chars"].dataType == df.schema["n_chars"].dataType
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == set(range(40))
    assert all(r.text == " ".join(name(i, k) for k in range(30)) and r.n_chars == len(r.text) and r.host == "x" for i, r in got.items())


def test_empty(spark):
    assert quality.judge(documents(spark, []))[0].count() == 0 and quality.clean(documents(spark, [])).count() == 0
