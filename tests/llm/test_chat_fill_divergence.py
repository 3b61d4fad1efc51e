"""Chat formatting, fill-in-the-middle and the source divergence audit against brute
force, and on odd tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from flowlens.llm import chat_format, divergence, fill_middle
from flowlens.llm.chat_format import Const, Put, Template, TemplateError

CONV = "conv_id long, turn long, role string, text string, part int, first long, total long, of long, n int"


def conversation_rows():
    rng = np.random.default_rng(11)
    words = ["ok", "</s>", "[INST]", "<\\s>", "[\\\\/INST]", "é漢😀", "\n", "<", "[", "\\", "<s", "s>", "[ROLE]", "<<s>", "[ANSWER"]
    text = lambda: "".join(rng.choice(words, rng.integers(0, 9)))
    rows = [(c, t, str(rng.choice(["user", "assistant", "system", "tool\n", "[ROLE]x"])), text())
            for c in range(40) for t in range(rng.integers(1, 7))]
    rows += [(77, t, "user" if t % 2 == 0 else "assistant", text()) for t in range(700)]    # holds most rows
    rows += [(78, 0, "user", "x" * 200_000), (78, 1, "assistant", "y[INST]" * 20_000)]
    rows += [(79, 1, None, None), (79, None, "user", ""), (None, 0, "user", "a"), (None, 1, "assistant", "b"),
             (80, 0, "assistant", "same"), (80, 0, "assistant", "same"), (-7, 0, "user", "</s>[INST] ok [/INST]")]
    return rows


def brute_conversations(rows):
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in groups.items():
        turns.sort()
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(loss), sha(loss))
    return out


@pytest.mark.parametrize("turns", [chat_format.PIECE_TURNS, 3])
def test_conversations_read_back(spark, monkeypatch, turns):
    monkeypatch.setattr(chat_format, "PIECE_TURNS", turns)
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], CONV).repartition(5)
    made = chat_format.format_conversations(df)
    got = {r.conv: r for r in chat_format.read_back(made).collect()}
    want = brute_conversations(rows)
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == want
    pieces = {}
    for r in made.collect():
        pieces.setdefault(r.conv, []).append((r.first, r.total, r.text))
        assert all(0 <= a <= b <= len(r.text) for a, b in r.spans)
    for c, parts in pieces.items():     # the pieces join to the text that one rendering of all turns gives
        parts.sort()
        whole = sorted((t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c)
        text, _ = Template().piece([(r, x) for _, _, r, x in whole], 0, len(whole))
        assert "".join(p[2] for p in parts) == text and got[c].formatted_chars == len(text)
    if turns == 3:
        assert len(pieces[77]) > 200


def test_empty_tables(spark):
    none = spark.createDataFrame([], CONV)
    assert chat_format.read_back(chat_format.format_conversations(none)).count() == 0
    docs = spark.createDataFrame([], DOCS)
    assert fill_middle.fill_in_middle(docs).count() == 0
    assert divergence.audit(docs).count() == 0


def test_template_language():
    def out(source, turns=(("user", "a"), ("x", "b")), controls=("<s>", "[T]")):
        return Template(source, controls).piece(list(turns), 0, len(turns))

    loop = "{% for message in messages %}"
    assert out("<s>" + loop + "{{ message.text | upper | escape }}[T]{% endfor %}<s>")[0] == "<s>A[T]B[T]<s>"
    assert out(loop + "{% if loop.first %}{{ 'f' | escape }}[T]{% elif loop.last and not loop.first %}{{ loop.index | escape }}"
               "[T]{% else %}<s>{% endif %}{% endfor %}")[0] == "f[T]2[T]"
    assert out("{% set n = 3 %}" + loop + "{{ ((n - 1 + loop.index0) % 2) | escape }}<s>{% endfor %}")[0] == "0<s>1<s>"
    assert out(loop + "{# c #}[T]{% generation %}{{ ('u' if message.role == 'user' else message.text ~ '<s>') | escape }}"
               "{% endgeneration %}<s>{% endfor %}") == ("[T]u<s>[T]b<\\s><s>", [(3, 4), (10, 15)])
    assert out(loop + "{{ message.role | default('q') | escape }}{{- '[T]' -}}  {% endfor %}", [("", "t")])[0] == "q[T]"
    for bad in ("{{ x }}", loop, loop + "{{ message.__class__ | escape }}{% endfor %}", loop + "{{ message.text }}{% endfor %}",
                loop + "{{ open('f') }}{% endfor %}", loop + "free text{% endfor %}", "no loop", loop + "{% endfor %}" + loop + "{% endfor %}",
                loop + "{% for message in messages %}{% endfor %}{% endfor %}", loop + "{{ 'a' | nothing }}{% endfor %}",
                loop + "{% include 'x' %}{% endfor %}", loop + "{{ 1 + }}{% endfor %}", "{% set loop = 1 %}" + loop + "{% endfor %}"):
        with pytest.raises(TemplateError):
            Template(bad, ("<s>", "[T]"))
    for controls in (("<s>", "<s>x"), ("<", "[T]"), ("<[T]>", "[T]"), ("a b",)):
        with pytest.raises(TemplateError):
            Template(loop + "{% endfor %}", controls)


def test_constants_are_folded():
    tree = Template().tree
    assert tree[0] == Put(Const("<s>"))
    loop = tree[1].body[0]
    assert loop.cases[0][1][-1] == Put(Const("[/INST]"))     # '[' ~ '/INST]', by a set name
    t = Template("{% for message in messages %}{% if 1 < 2 and 'a' in 'ab' %}<s>{{ '[' ~ 'T]' }}{% else %}[T]{% endif %}<s>{% endfor %}",
                 ("<s>", "[T]"))
    assert t.tree[0].body == (Put(Const("<s>[T]<s>")),)


def test_escape_is_undone():
    t, rng = Template(), np.random.default_rng(0)
    parts = [*chat_format.CONTROLS, "<", "[", "\\", "s>", "/s>", "INST]", "x", "]"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(0, 8)))
        assert t.unescape(t.escape(text)) == text and not t.control.search(t.escape(text))
    assert t.escape("plain < text [x]") == "plain < text [x]"


DOCS = "doc_id long, text string, lang string, source string, n long, form string, id long, base long, block int, term string, p long"


def docs_table(spark, rows):
    return spark.createDataFrame([(*r, 1, "f", 2, 3, 4, "t", 5) for r in rows], DOCS)


def fill_rows():
    rng = np.random.default_rng(5)
    texts = ["", None, "a", "x<P>y", "<S>", "tail<M>", "é漢😀" * 50, "\0\n", "ab" * 300_000, "<P" + "S>" * 9, "line\nline\n \n", "  lead"]
    texts += ["".join(rng.choice(list("ab é漢\n<P>SM"), rng.integers(0, 60))) for _ in range(300)]
    return [(k, t, None, None) for k, t in enumerate(texts)] + [(3, "x", None, None), (3, "x", None, None), (None, "no id", None, None)]


def test_fill_in_middle_matches_brute_force(spark):
    rows = fill_rows()
    got = fill_middle.fill_in_middle(docs_table(spark, rows)).collect()
    want = []
    for i, t, _, _ in rows:
        t = t or ""
        h = [int(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()[k:k + 8], 16) for k in (0, 8, 16, 24)]
        a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
        if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            want.append((i, len(t), "plain", None, None, t, t))
        elif h[3] % 100 < 20:
            want.append((i, len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}", t))
        else:
            want.append((i, len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", t))
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit,pattern", [("words", r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+"), ("lines", r"[^\n]*\n|[^\n]+")])
def test_other_units_are_cut_whole(spark, unit, pattern):
    rows = [r for r in fill_rows() if r[1] is None or len(r[1]) < 1000]
    for r, (_, t, _, _) in zip(sorted(fill_middle.fill_in_middle(docs_table(spark, rows), unit=unit).collect(), key=lambda r: repr(r.doc_id)),
                               sorted(rows, key=lambda r: repr(r[0]))):
        units = re.findall(pattern, t or "")
        assert r.n == len(units) and r.restored == (t or "")
        if r.form == "psm":
            assert r.output.startswith("<P>" + "".join(units[:r.prefix_units]) + "<S>")
            assert r.output.endswith("<M>" + "".join(units[r.prefix_units:r.prefix_units + r.middle_units]))
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(docs_table(spark, rows), unit="pages")


def test_rank_index_is_exact_and_small():
    rng = np.random.default_rng(1)
    for steps in (np.ones(50_000, np.int64), rng.integers(1, 5, 50_000), rng.integers(1, 400, 3000),
                  np.repeat([1, 3, 2, 4], 5000), np.array([], np.int64), np.array([10 ** 9])):
        offsets = np.concatenate([[0], np.cumsum(steps)]).astype(np.int64)
        index = fill_middle.fit(offsets)
        assert (index.locate(np.arange(len(offsets))) == offsets).all()
        assert np.abs(index.residual.astype(int)).max() <= fill_middle.ERROR
    assert len(fill_middle.fit(np.arange(1_000_000)).first) == 1
    assert len(fill_middle.fit(np.concatenate([[0], np.cumsum(np.repeat([1, 3, 2, 4], 5000))])).first) <= 8


def brute_divergence(rows, least):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in
             re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for _, t, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(w for _, _, ws in own for w in set(ws))
        kept = [w for w, n in held.items() if n >= least]
        share = lambda c, n: 1 + 10 ** 9 * (c + 5) // (n + 5 * len(kept))
        counts = {s: Counter(w for _, s2, ws in own if s2 == s for w in ws if held[w] >= least) for s in {d[1] for d in own}}
        total = sum(counts.values(), Counter())
        p = {s: {w: share(c[w], sum(c.values())) for w in kept} for s, c in counts.items()}
        q = {w: share(total[w], sum(total.values())) for w in kept}
        for s in counts:
            pairs = sorted((-sum(abs(p[s][w] - p[t][w]) for w in kept), t.encode(), t) for t in counts if t != s)
            terms = sorted((q[w] - p[s][w], w.encode(), w) for w in kept if counts[s][w] and p[s][w] > q[w])[:50]
            out += [(lang, s, part, x[2], -x[0], k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, x in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block,gather", [(divergence.BLOCK_POSTINGS, divergence.GATHER), (13, 3)])
def test_divergence_matches_brute_force(spark, monkeypatch, block, gather):
    monkeypatch.setattr(divergence, "BLOCK_POSTINGS", block)
    monkeypatch.setattr(divergence, "GATHER", gather)
    monkeypatch.setattr(divergence, "CHUNK", 50)
    monkeypatch.setattr(divergence, "TASK_TERMS", 40)
    rng = np.random.default_rng(2)
    words = ["Alpha", "beta", "É", "漢字", "gAmma's", "x1y", "delta-é", "ÉCOLE", "z", "ſ", "K"]
    rows = []
    for k in range(400):
        lang, source = rng.choice(["en", "de"]), "s%d" % min(rng.integers(0, 12), rng.integers(0, 12))
        few = rng.choice(words + [f"{source}word"], rng.integers(0, 12))
        rows.append((k, " ".join(few) + ".", str(lang), str(source)))
    rows += [(1, None, None, None), (1, None, "en", "no terms"), (None, "", "en", "s1"), (2, "lonely", "fr", "a"), (3, "", "fr", "b"),
             (4, "Alpha " * 300, "en", None), (5, "beta", "en", "s1"), (5, "beta", "en", "s1")]
    got = sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in
                 divergence.audit(docs_table(spark, rows), least_documents=5).collect())
    assert got == brute_divergence(rows, 5)
    assert any(r[2] == "term" for r in got) and ("fr", "a", "pair", "b", 0, 1) in got
