import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexaria.llm import boilerplate, boosting, langid, leaks, markup, near
from lexaria.llm.words import plain_words, words

WORDS = [a + b for a in ("ca", "lo", "mi", "ru", "te", "so", "pa", "ne") for b in ("sa", "ra", "to", "lin", "mo", "da", "ves", "gu")]


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


# near-duplicates


def jaccard(a, b, n=3):
    x, y = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (words(a), words(b)))
    return len(x & y) / len(x | y) if x | y else 0


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(8)
    texts = {}
    for i in range(60):
        base = sentence(rnd, 120).split()
        texts[10 * i] = " ".join(base)
        for k in range(rnd.randint(0, 3)):
            copy = list(base)
            for _ in range(rnd.randint(0, 5)):
                copy[rnd.randrange(len(copy))] = rnd.choice(WORDS)
            texts[10 * i + k + 1] = " ".join(copy).upper() if k == 1 else " ".join(copy)
    rows = [(i, t, 1.0) for i, t in texts.items()] + [(5, None, 1.0), (None, "x", 1.0), (6, "", 1.0), (7, "dos palabras", 1.0), (8, "dos palabras", 1.0), (0, texts[0], 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, texto string, similarity double")
    scheme = near.BallScheme(shingle=3)
    members, pairs = near.near_duplicates(df, "doc_id", "texto", threshold=0.6, scheme=scheme)
    got = {tuple(r) for r in near.all_links(members, pairs).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(texts), 2) if jaccard(texts[a], texts[b]) >= 0.6}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 40
    assert 0.2 < scheme.most_bits(0.6) / scheme.signature_bits() < 0.4 and scheme.most_bits(1.0) == 0
    assert scheme.recall(0.7) > 0.99 and scheme.recall(0.6) > 0.9
    classes = {r["id"]: (r["class_id"], r["links"]) for r in near.connected_classes(members, pairs).collect()}
    for a, b in got:
        assert classes[a][0] == classes[b][0]
    for i in classes:
        assert classes[i][1] == sum(i in p for p in got)
    short = {r["id"]: r["rep"] for r in near.short_members(df, "doc_id", "texto", members, 3).collect()}
    assert short == {5: 5, 6: 6, 7: 7, 8: 7}
    # no filter by signatures
    bare = near.near_duplicates(df, "doc_id", "texto", threshold=0.6, scheme=near.BallScheme(shingle=3, signature=0))
    assert {tuple(r) for r in near.all_links(*bare).collect()} == got
    m, p = near.near_duplicates(df.limit(0), "doc_id", "texto")
    assert m.count() == 0 and p.count() == 0 and near.connected_classes(m, p).count() == 0


def test_few_links_at_the_threshold_are_missed():
    from statistics import NormalDist

    s = near.BallScheme(shingle=3)
    assert s.recall(0.6) > 0.99 and s.recall(0.7) > 0.9998
    k, q = s.signature_bits(), 0.2
    assert NormalDist(k * q, (k * q * (1 - q)) ** 0.5).cdf(s.most_bits(0.6)) > 1 - 1e-6
    assert near.BallScheme(tables=2).signature_bits() == 16


def test_ball_meets_in_the_middle():
    s = near.BallScheme(bits=7, radius=2)
    flips = {int(x) for x in s.flips()}
    for a, b in itertools.product(range(0, 128, 5), range(128)):
        meet = {a ^ f for f in flips} & {b ^ f for f in flips}
        assert bool(meet) == ((a ^ b).bit_count() <= 2)


def test_page_keys(spark):
    same = ["https://www.Host.example/a/%7Eb/index.html?x=1&y=2#top", "http://host.example:80/a/~b?y=2&x=1&utm_source=z&sid=9", "https://HOST.example:443/a/~b/?ref=q&y=2&x=1"]
    assert len({near.same_page_key(u) for u in same}) == 1
    other = ["http://host.example/a/~B?x=1&y=2", "http://host.example/a/~b?x=2&y=2", "http://host.example:8080/a/~b?x=1&y=2", "http://x.host.example/a/~b?x=1&y=2", "http://host.example/a/%2Fb?x=1&y=2"]
    assert len({near.same_page_key(u) for u in [*other, same[0]]}) == 6
    assert near.same_page_key(None) is None and near.same_page_key(" ") is None and near.same_page_key("http://[x") == "http://[x"
    df = spark.createDataFrame([(1, same[0]), (1, same[1]), (2, None), (None, same[0])], "id int, url string")
    assert near.same_pages(df, "id", "url").count() == 1


# leaks


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(2)
    items = [(i, sentence(rnd, rnd.randint(5, 40))) for i in range(25)] + [(90, None), (91, "a b"), (92, "a b c d e"), (3, "otro texto con el mismo id aqui")]
    docs = []
    for d in range(80):
        t = sentence(rnd, rnd.randint(0, 60)).split()
        if d % 3 == 0:
            w = items[d % 25][1].split()
            lo = rnd.randrange(len(w))
            t[rnd.randrange(len(t) + 1) : 0] = w[lo : lo + rnd.randint(3, 40)]
        docs.append((d, ", ".join(t).replace("a", "á", 3).title() if d % 2 else " ".join(t)))
    docs += [(200, None), (201, ""), (202, "xx a b c d e yy"), (202, "xx a b c d e yy")]

    def runs(t):
        w = plain_words(t or "")
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = sorted({(d, i) for d, t in docs for i, u in items if runs(u) and len(runs(t) & runs(u)) >= 0.4 * len(runs(u))})
    a = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(*x, "s") for x in items], "item_id long, text string, doc_id string")
    got = leaks.find_leaks(a, "doc_id", "text", b, "item_id", "text")
    assert sorted({(r["doc_id"], r["item_id"]) for r in got.select("doc_id", "item_id").collect()}) == want and len(want) > 5
    assert leaks.find_leaks(a.limit(0), "doc_id", "text", b, "item_id", "text").count() == 0
    assert leaks.find_leaks(a, "doc_id", "text", b.limit(0), "item_id", "text").count() == 0


def aligned(a, b, lo, hi, n=2):
    codes = {}
    x, y = (np.array([codes.setdefault(w, len(codes)) for w in t], dtype=np.int32) for t in (a, b))
    # beside a longer item on another document
    items = np.full((2, len(x) + 3), -2, dtype=np.int32)
    items[0, : len(x)] = x
    items[1] = 77
    words = np.r_[np.full(3, 5, dtype=np.int32), y, 77, 77]
    edits, held = leaks.banded_alignment(items, np.array([len(x), len(x) + 3]), words, np.array([3, 0]), np.array([len(y), 3]), np.array([lo, 0]), hi - lo + 1, n)
    assert not held[0, len(x) - n + 1 :].any() and not held[1].any()
    return int(edits[0]), held[0, : len(x) - n + 1].tolist()


def test_banded_alignment():
    a, b = "uno dos tres cuatro cinco".split(), "x y uno dos TRES cuatro cinco z".split()
    assert aligned(a, b, -1, 5) == (1, [True, False, False, True])
    assert aligned(a, a, -2, 2) == (0, [True] * 4)
    assert aligned(a, [], -2, 2) == (len(a), [False] * 4)
    assert aligned(a, "x y uno dos cuatro cinco".split(), -1, 5) == (1, [True, False, False, True])
    rnd = random.Random(5)
    for _ in range(150):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(3, 14))] for _ in range(2))
        lo = rnd.randint(-12, 12)
        hi = lo + rnd.randint(0, 9)
        held = [any(0 <= i + d and b[i + d : i + d + 3] == a[i : i + 3] for d in range(lo, hi + 1)) for i in range(len(a) - 2)]
        # cell (i, j) of the alignment lies on diagonal j - i
        best = {(0, j): 0 for j in range(len(b) + 1) if lo <= j <= hi}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                if lo <= j - i <= hi and i:
                    ways = [best.get((i - 1, j), 99) + 1]
                    if j:
                        ways += [best.get((i - 1, j - 1), 99) + (a[i - 1] != b[j - 1]), best.get((i, j - 1), 99) + 1]
                    best[(i, j)] = min(ways)
        edits = min([len(a), *(v for (i, _), v in best.items() if i == len(a))])
        assert aligned(a, b, lo, hi, 3) == (edits, held)


def test_leaks_come_from_the_alignment(spark, monkeypatch):
    item = "uno dos tres cuatro cinco seis siete ocho nueve diez once doce"
    # moved parts lie on far diagonals, the edited copy on one
    docs = [(1, "a b " + item), (2, "seis siete ocho nueve diez once doce " + "z " * 60 + "uno dos tres cuatro cinco seis"), (3, item.replace("seis", "X")), (4, "uno dos tres cuatro z cinco seis siete ocho")]
    rows = list(leaks._scan([d for d, _ in docs], [t for _, t in docs], leaks.build_index([(7, item)], 5, 0.4), 5, leaks.BAND))
    assert [(r[0], r[2], r[3]) for r in rows] == [(1, 8, 8), (2, 8, 5)]
    assert rows[0][4] == 0 and rows[1][4] == 5
    monkeypatch.setattr(leaks, "banded_alignment", lambda items, *a: (np.zeros(len(items), dtype=int), np.zeros((len(items), items.shape[1] - 4), dtype=bool)))
    assert not list(leaks._scan([1], [docs[0][1]], leaks.build_index([(7, item)], 5, 0.4), 5, leaks.BAND))


def _aligned_shapes(monkeypatch):
    shapes, align = [], leaks.banded_alignment
    monkeypatch.setattr(leaks, "banded_alignment", lambda items, *a: shapes.append(items.shape) or align(items, *a))
    return shapes


def test_leaks_align_only_where_runs_can_stand(monkeypatch):
    # a short run among long words; the first document has most of the words in place, but no five in a row
    w = [f"palabra{k:04d}" for k in range(40)]
    w[20:25] = "abcde"
    item = " ".join(w)
    shapes = _aligned_shapes(monkeypatch)
    ix = leaks.build_index([(7, item)], 5, 0.4)
    assert not list(leaks._scan([1], [" ".join("X" if k % 3 == 2 else x for k, x in enumerate(w))], ix, 5, leaks.BAND)) and not shapes
    assert list(leaks._scan([2], ["y z " + item], ix, 5, leaks.BAND)) == [(2, 7, 36, 36, 0)] and shapes


def test_leaks_align_items_at_their_own_length(monkeypatch):
    items = [(1, "uno dos tres cuatro cinco seis siete ocho nueve diez once doce"), (2, " ".join(f"{k:04d}" for k in range(2000)))]
    shapes = _aligned_shapes(monkeypatch)
    docs = [f"{k} " + items[0][1] for k in range(30)]
    rows = list(leaks._scan(list(range(30)), docs, leaks.build_index(items, 5, 0.4), 5, leaks.BAND))
    assert rows == [(k, 1, 8, 8, 0) for k in range(30)] and max(most for _, most in shapes) == 12
    assert [r[:4] for r in leaks._scan([9], [items[1][1] + " fin"], leaks.build_index(items, 5, 0.4), 5, leaks.BAND)] == [(9, 2, 1996, 1996)]


def test_leaks_of_any_run_length_in_slices(monkeypatch):
    monkeypatch.setattr(leaks, "SCANNED", 200)
    monkeypatch.setattr(leaks, "ALIGNED", 2000)
    rnd = random.Random(8)
    items = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 30)))) for i in range(30)]
    docs = [(d, None if d % 17 == 0 else " ".join(rnd.choice("abcx") for _ in range(rnd.choice((0, 3, 40, 90))))) for d in range(60)]
    # runs that only stand over the end of a document are none
    docs += [(100, "p q r"), (101, "s t u"), (102, "p q r s t u")]
    items += [(100, "p q r s t u")]
    for n in (1, 2, 3, 5):

        def runs(t):
            w = plain_words(t or "")
            return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

        want = sorted((d, i, len(runs(u)), len(runs(t) & runs(u))) for d, t in docs for i, u in items if runs(u) and len(runs(t) & runs(u)) >= 0.4 * len(runs(u)))
        got = sorted(r[:4] for r in leaks._scan([d for d, _ in docs], [t for _, t in docs], leaks.build_index(items, n, 0.4), n, leaks.BAND))
        assert got == want and len(want) > 5 and (n < 5 or [d for d, i, *_ in got if i == 100] == [102])


# languages

LINES = {
    "es": ["la casa de la ciudad que está cerca del río y los niños que juegan con las flores", "el perro no quiere salir porque hace mucho frío en la calle esta mañana"] * 5,
    "en": ["the house in the town that is near the river and the children who play with flowers", "the dog does not want to go out because it is very cold in the street this morning"] * 5,
    "de": ["das haus in der stadt die nahe am fluss liegt und die kinder die mit den blumen spielen", "der hund will nicht hinaus weil es heute morgen auf der straße sehr kalt ist"] * 5,
}
ES, EN = "Los niños juegan en la calle con las flores que están cerca de la casa del río.", "The children play in the street with the flowers that are near the house of the river."


def test_languages(spark):
    p = langid.Profiles(LINES)
    rows = [(1, ES), (2, EN.upper()), (3, f"{ES}\n\n{EN}\n\n\n\n{ES} «the house of the river»"), (4, None), (5, ""), (6, "12 34 !!"), (7, f"```\nthe house in the town that is near the river and the children\n```\n\n{ES}"), (1, ES)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, texto string, lang string")
    got = langid.identify(df, "doc_id", "texto", p).collect()
    whole = {r["doc_id"]: r for r in got if r["seg"] == -1}
    assert set(whole) == {1, 2, 3, 5, 6, 7} and whole[1]["lang"] == "es" and whole[2]["lang"] == "en" and whole[5]["lang"] is None and whole[6]["confidence"] == 0
    assert {(r["seg"], r["lang"]) for r in got if r["doc_id"] == 3 and r["seg"] >= 0} == {(0, "es"), (1, "en"), (3, "es")}
    assert whole[3]["mixed"] and not whole[7]["mixed"] and whole[7]["lang"] == "es"
    assert langid.identify(df.limit(0), "doc_id", "texto", p).count() == 0
    with pytest.raises(ValueError):
        langid.train_profiles(spark.createDataFrame([], "l string, t string"), "l", "t")


def test_sample_of_lines_has_every_language(spark):
    rows = [(lang, f"{t} {i}") for lang, ts in LINES.items() for i, t in enumerate(ts * 3)]
    df = spark.createDataFrame([*rows, (None, "x"), ("es", None)], "l string, t string")
    assert sorted(langid.train_profiles(df, "l", "t", max_lines=6).langs) == ["de", "en", "es"]


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("es-AR", "ES", "Español", " spa ", "en_GB", "?", "", None, "nl", "Deutsch")], "l string")
    assert [r[0] for r in df.select(langid.label_code(F.col("l"))).collect()] == ["es", "es", "es", "es", "en", None, None, None, None, "de"]


# markup

MARKUP = {
    "html": "<html><head><title>no</title></head><body><h2 id=a>Uno &amp; <b>dos</b></h2><p>x <!-- c --><ul><li>a<li class=k>b <i>c</i></li></ul>y \\(z^2\\)<pre><code>if a &lt; b:\n  c</code></pre>",
    "markdown": "# Uno **dos** #\n\nTres\n----\n\ntexto [a](http://x) ![i](j.png) $q_1$\n\n- a `b`\n2. c\n\n```py\nx = 1\n# no\n```\n\n    d = 2\n",
    "wiki": "== '''Uno''' dos ==\n\n* [[A|b]]<ref>n</ref>\n# c {{nota|x}}\n\n:<math>a &lt; b</math>\n{| class=x\n! h\n|}\n<syntaxhighlight lang=\"x\">\nfor\n</syntaxhighlight>\n",
    "latex": "\\documentclass{article}\n\\begin{document}\n\\section*{Uno \\textbf{dos}}\\label{s}\nx\\footnote{n} $a$\n\\begin{itemize}\n\\item a {\\it b}\n\\item c\n\\end{itemize}\n% no\n\\begin{verbatim}\nz $ y\n\\end{verbatim}\n\\end{document}",
}
WANT = {
    "html": [("heading", "Uno & dos"), ("item", "a"), ("item", "b c"), ("formula", "z^2"), ("code", "if a < b: c")],
    "markdown": [("heading", "Uno dos"), ("heading", "Tres"), ("formula", "q_1"), ("item", "a b"), ("item", "c"), ("code", "x = 1 # no"), ("code", "d = 2")],
    "wiki": [("heading", "Uno dos"), ("item", "b"), ("item", "c"), ("formula", "a &lt; b"), ("code", "for")],
    "latex": [("heading", "Uno dos"), ("formula", "a"), ("item", "a b"), ("item", "c"), ("code", "z $ y")],
}


@pytest.mark.parametrize("syntax", list(MARKUP))
def test_markup(syntax):
    p = markup.parse(MARKUP[syntax])
    got = [(e.kind, e.text) for e in markup.elements(p.root) if e.kind in ("heading", "item", "code", "formula")]
    assert p.syntaxes == [syntax]
    assert sorted(got) == sorted(WANT[syntax])
    text = markup.render(p.root)
    assert "# Uno" in text and "- c" in text or syntax == "html"
    assert "\\textbf" not in text and "<" not in text.replace("a < b", "").replace("&lt;", "")


def test_formula_alone_is_no_latex():
    p = markup.parse("plain text with $x_1 + y$ inside")
    assert p.syntaxes == [] and [e.text for e in markup.elements(p.root) if e.kind == "formula"] == ["x_1 + y"]


def test_wiki_tables():
    def parsed(text):
        p = markup.parse(text)
        return markup.render(p.root), [(e.kind, e.text) for e in markup.elements(p.root) if e.kind != "paragraph"]

    table = "== Uno ==\n{| class=\"x\"\n|+ pie\n! style=\"a\" | alto !! [[A|ancho]]\n|- id=r\n| 25 || <math>q</math>\n| colspan=2 | {{n|a||b}} fin\n{|\n| dentro\n|}\n|-\n|\n* punto\n"
    want = ("# Uno\n\npie\n\nalto ancho\n\n25 q fin\n\n$$q$$\n\ndentro\n\n- punto", [("heading", "Uno"), ("formula", "q"), ("item", "punto")])
    text, found = parsed(table + "|}\n")
    assert [x for x in text.split("\n\n") if x != "$$q$$"] == [x for x in want[0].split("\n\n") if x != "$$q$$"] and sorted(found) == sorted(want[1])
    # an indented end, text after it, and a template's end that is none
    assert parsed("{|\n| a\n  |} b\n== Dos ==\n* c") == ("a\n\nb\n\n# Dos\n\n- c", [("heading", "Dos"), ("item", "c")])
    assert "d" in parsed("{|\n| {{x\n|}} d\n|}\n== Dos ==\n")[0]
    # never closed: ordinary text
    text, found = parsed("{| sola\nuna frase\n== Dos ==\n* c\n")
    assert "sola una frase" in text and found == [("heading", "Dos"), ("item", "c")]


def test_template_removal(spark):
    rows = [(i, "h" if i < 30 else None, f"<html><body><ul><li>menu</li></ul><h1>Title {i}</h1><p>{sentence(random.Random(i), 9)}</p></body></html>") for i in range(32)]
    rows += [(100, "h", None), (None, "h", "x"), (101, None, ""), (102, "g", "* not markup"), (0, "h", rows[0][2])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, host string, text string, h int")
    got = {r["id"]: r for r in markup.clean_markup(df).collect()}
    assert "menu" not in got[3]["contents"] and "Title 3" in got[3]["contents"] and "menu" in got[31]["contents"]
    assert set(got) == {*range(32), 101, 102} and got[101]["clean_text"] == ""
    assert markup.clean_markup(df.limit(0)).count() == 0


def test_templates_go_and_usual_headings_stay(spark):
    rows = []
    for i in range(24):
        rnd = random.Random(i)
        menu = "# Secciones\n\n- inicio\n- buscar\n- contacto\n\n"
        rows.append((i, "h", f"{menu}# Titulo {i}\n\n{sentence(rnd, 12)}\n\n# Referencias\n\n- punto {i}\n- {'comun' if i % 2 else 'otro'}\n- fin {i}\n\n{sentence(rnd, 9)}\n"))
    df = spark.createDataFrame(rows, "id long, host string, text string")
    got = {r["id"]: r for r in markup.clean_markup(df).collect()}
    for i in range(24):
        assert got[i]["contents"] == [f"Titulo {i}", "Referencias", f"punto {i}", "comun" if i % 2 else "otro", f"fin {i}"]
        assert "buscar" not in got[i]["clean_text"] and "# Referencias" in got[i]["clean_text"]
    assert {r["id"]: r["contents"] for r in markup.clean_markup(df, with_text=False).collect()} == {i: r["contents"] for i, r in got.items()}


HARD = {
    "math": "<math>" * 11_000, "bracket": "\\[ " * 23_000, "stars": "**a " * 17_000, "pre": "<pre>" * 20_000, "ref": "<ref>a " * 15_000 + "[[x]]", "templates": "[[a]] " + "{{a " * 15_000 + "}}" * 15_000,
    "bold": "\\section{a}" + "\\textbf{" * 10_000 + "}" * 10_000, "comments": "<p>" + "<!-- " * 20_000, "ticks": "# a\n" + "`" * 70_000, "spaces": "# a" + " " * 70_000 + "b", "images": "# a\n" + "![" * 30_000,
    "links": "# a\n" + "[a](" * 20_000, "addresses": "[[a]] " + "[//" * 20_000, "quotes": "\\section{a}" + "``a " * 20_000, "struck": "# a\n" + "~~a " * 20_000, "cells": "[[a]]\n{|\n" + "| [[a " * 15_000 + "\n|}",
}


@pytest.mark.parametrize("name", list(HARD))
def test_time_grows_with_the_text(name):
    import time

    start = time.perf_counter()
    markup.render(markup.parse(HARD[name]).root)
    assert time.perf_counter() - start < 1.5


def test_deep_nesting():
    for tag in ("div", "section", "ul><li"):
        p = markup.parse(f"<{tag}>" * 100_000 + "fin")
        markup.prune(p.root, {p.root.children[0].mark + 1})
        assert markup.render(p.root).endswith("fin")
        assert sum(1 for _ in markup.elements(p.root)) >= 100_000


def test_latex_and_templates_inside_out():
    assert markup.clean_tex(r"a~\cite{k} {\it b}c \href{u{x}}{d \textbf{e}} \% ``f'' \unknown g\footnote{h {i} j}").split() == "a bc d e % f g".split()
    assert markup.clean_wiki("a {{b|{{c}} d}} e {{f }} g }} h") == "a  e  g }} h"
    assert markup.clean_markdown("**a** __b c__ ~~d~~ x__y__z *e* _f_ **g ** h") == "a b c d x__y__z e f *g * h"


# page boilerplate


def page(rnd, host, title):
    body = [" ".join(sentence(rnd, 14).capitalize() + "." for _ in range(3)) for _ in range(4)]
    return "\n".join(["Inicio · Buscar · Contacto", f"Usted está aquí: Inicio > {title}", title, body[0], "Imprimir", "Etiquetas", "- casa rato", "- mito luna", body[1], rnd.choice(("Método", "Resultados", "Discusión", "Antecedentes", "Fuentes", "Glosario", "Apéndice")), *body[2:], "", f"© 2020 {host} - Todos los derechos reservados"])


def test_boilerplate(spark):
    rnd = random.Random(1)
    rows = [(i, f"www.h{i % 3}.example" if i % 5 else None, page(rnd, f"h{i % 3}.example", f"Titulo {WORDS[i]}")) for i in range(40)]
    rows += [(90, "x", None), (None, "x", "y"), (91, "x", ""), (92, None, " \n\n"), (1, rows[1][1], rows[1][2])]
    df = spark.createDataFrame([(*r, True) for r in rows], "id long, host string, text string, boilerplate boolean")
    got = boilerplate.page_lines(df)
    flags = {(r["id"], r["line"]): r["boilerplate"] for r in got.collect()}
    for i in range(40):
        assert [k for k in range(15) if flags.get((i, k))] == [0, 1, 4, 5, 6, 7, 13]
    assert not any(i in (90, 91, 92) for i, _ in flags)
    assert boilerplate.page_lines(df.limit(0)).count() == 0


def test_notices_and_long_legal_texts(spark):
    rnd = random.Random(4)
    notice = "Este site grava cookies no seu aparelho; ao continuar, você concorda com a nossa política de privacidade."
    legal = " ".join(sentence(rnd, 20).capitalize() + "." for _ in range(3))
    copied = page(rnd, "h0.example", "Titulo copiado").split("\n")
    rows = []
    for i in range(40):
        lines = list(copied) if i % 5 == 0 else page(rnd, f"h{i % 3}.example", f"Titulo {WORDS[i]}").split("\n")
        # one host repeats the legal text, all hosts the notice
        rows.append((i, f"h{i % 3}.example", "\n".join([notice, *lines, *([legal] if i % 3 == 1 else [])])))
    df = spark.createDataFrame(rows, "id long, host string, text string")
    flags = {(r["id"], r["line"]): r["boilerplate"] for r in boilerplate.page_lines(df).collect()}
    assert len(legal) > 200
    for i in range(40):
        assert [k for k in range(17) if flags.get((i, k))] == [0, 1, 2, 5, 6, 7, 8, 14, *([15] if i % 3 == 1 else [])]


def prose(rnd, n=3):
    return " ".join(sentence(rnd, 14).capitalize() + "." for _ in range(n))


def strange(rnd, host, title):
    """A page of a site in a language of its own: no word of it stands in any list."""
    pick = rnd.choice
    body = [prose(rnd), pick(("Zorv", "Kelimu", "Tarxo", "Vunek", "Oplir", "Dramz")), prose(rnd), "Quxil", prose(rnd)]
    lines = ["Brix", "Vold", "Nurp", title, *body, "Plomik", f"Wexa {pick(WORDS)}", f"Wexa {pick(WORDS)} {pick(WORDS)}", f"Hesk {pick(WORDS)}", "Snorg uval"]
    return "\n".join(lines), [0, 1, 2, 7, 9, 10, 11, 12, 13]


def test_boilerplate_of_unknown_words(spark):
    rnd = random.Random(11)
    rows, want = [], {}
    for i in range(60):
        text, want[i] = strange(rnd, "h", f"Gral {WORDS[i]} {WORDS[-i]}")
        rows.append((i, f"h{i % 4}.example", text))
    df = spark.createDataFrame(rows, "id long, host string, text string")
    got = {(r["id"], r["line"]) for r in boilerplate.page_lines(df).where("boilerplate").collect()}
    right = {(i, k) for i, v in want.items() for k in v}
    assert len(got & right) >= 0.95 * len(right) and len(got & right) >= 0.95 * len(got)


def test_facts_of_lines(spark):
    # host 1 has three pages with line 7, host 2 one of two; line 8 is an entry of two menus
    rows = [(i, 1, 7, i, False) for i in range(3)] + [(3, 2, 7, 3, False), (4, 2, 9, 4, False), (0, 1, 8, 0, True), (1, 1, 8, 1, True), (5, None, 7, 3, False)]
    df = spark.createDataFrame(rows, "id long, h long, key long, mark long, part boolean")
    got = {r["key"]: (r["spread"], round(r["share"], 6), r["parts"]) for r in boilerplate.line_facts(df).collect()}
    assert got == {7: (4, round(6 / 7, 6), 0), 8: (0, -1.0, 2)}


def test_decoding_never_contradicts_itself():
    rnd = random.Random(3)
    facts = {boilerplate.line_hash("cabeza"): boilerplate.Fact(9, 1.0, 0), boilerplate.line_hash("otra"): boilerplate.Fact(9, 1.0, 0)}
    for _ in range(200):
        lines = rnd.choices(["Cabeza", "una cosa", "- cosa dos", "Otra", "Inicio · Buscar", "Una frase que es larga y tiene punto final."], k=12)
        p = boilerplate.parse_page("\n".join(lines), "", facts)
        out = boilerplate.decode(p, [rnd.random() for _ in p.nodes])
        assert all(not n.item or out[i] or not out[n.parent] for i, n in enumerate(p.nodes))
        assert sorted(i for b in p.blocks for i in b) == list(range(len(p.nodes)))


def test_title_after_an_unmarked_list():
    facts = {boilerplate.line_hash("etiquetas"): boilerplate.Fact(9, 1.0, 0)}
    p = boilerplate.parse_page("Etiquetas\nuna cosa\notra cosa\nEl titulo\n" + "Una frase larga con muchas palabras que termina aqui sin falta. " * 2, "", facts)
    assert [x.item for x in p.nodes] == [0, 1, 2, 0, 0]
    out = boilerplate.decode(p, [0.9, 0.9, 0.9, 0.4, 0.1])
    assert out.tolist() == [True, True, True, False, False]


def test_boosted_trees():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = boosting.fit(x[:2000], y[:2000], rounds=60)
    assert ((m.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert (boosting.fit(x, np.ones(3000)).predict(x) > 0.9).all()
    assert len(boosting.fit(np.zeros((0, 4)), np.zeros(0)).predict(np.zeros((2, 4)))) == 2
