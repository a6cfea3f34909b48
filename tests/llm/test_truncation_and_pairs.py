import json
import random
from datetime import datetime

import numpy as np
import pytest
from conftest import rows

from orefield.llm import truncation
from orefield.llm.pairs import broken_pairs, calibrated, parsed
from orefield.llm.truncation import code_fault, cut_rates, cut_values, judged, open_marks

AT = datetime(2025, 1, 1)
NOUNS = "cursor snapshot ledger window index batch parser token queue report anchor folder budget guard entry".split()
SCHEMA = "id string, model string, summary string, result_json string, input_json string, raw_response string, loaded_at timestamp, word string, text string, field string"


def sentence(rng):
    a, b, c = rng.sample(NOUNS, 3)
    return rng.choice([
        f"The {a} merges the {b} quietly, so the {c} is reloaded.", f"Keep the {a} frozen until the {b} has renamed every {c}.", f"Each {a} maps the {b} to the {c}, and memory grows with the {a}.",
        f"The {a} is kept for 900 days and then sealed.", f"It's the {a} that hides the {b}, not the {c}.", f"Prefer the {a} over the {b} unless the {c} was dropped early.",
    ])


def review(i, summary, title="Nothing to report", code=None, model="m", raw=None, prompt=None):
    result = json.dumps({"verdict": "skip", "title": title, "summary": summary, "suggested_code": code})
    return (i, model, summary, result, prompt, raw, AT, "", "", "")


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_cut_values_are_found_and_complete_ones_are_not(spark):
    rng = random.Random(6)
    data = [review(f"ok{n}", " ".join(sentence(rng) for _ in range(3))) for n in range(300)]
    whole = {"list": sentence(rng) + "\n- cursor\n- frozen index", "bare": "Keep the cursor frozen until the batch has renamed every token", "quote": 'It stays. The same holds for "index".', "etc": "Windows, batches etc.", "empty": "", "german": "Einer liest „Zähler erst zurücksetzen“ und endet."}
    data += [review(f"ok-{k}", v) for k, v in whole.items()]
    cut = {"word": "The cursor is kept for 900 days and then sealed. The led", "open": "Keep the cursor frozen until the", "span": "The cursor calls `readTok", "sign": "The cursor merges the wind…", "mark": "The cursor merges the window and [cut]", "bracket": "The cursor (see the window of", "dots": "Each cursor maps the bat..."}
    data += [review(f"cut-{k}", v) for k, v in cut.items()]
    codes = {"ok-call": "a.b(c)", "ok-fn": "function f(a) {\n  return a;\n}", "ok-diff": "- const a = b(c);\n+ const a = await b(c);", "cut-fn": "function f(a) {\n  return", "cut-str": "f('abc", "cut-call": "cursor.reo", "cut-diff": "- const a = b(c);\n+ const a = aw"}
    data += [review(i, sentence(rng), code=c) for i, c in codes.items()]
    data += [review("null", None, None), ("bad", "m", None, "no json", None, None, AT, "", "", ""), (None, *data[0][1:])]
    got = {(r.review_id, r.field) for r in cut_values(frame(spark, data + data[:30])).collect()}
    want = {(f"cut-{k}", "summary") for k in cut} | {(i, "suggested_code") for i in codes if i.startswith("cut")}
    assert got == want
    rates = {(r.model, r.field): r.n_cut for r in cut_rates(frame(spark, data)).collect()}
    assert rates["m", "summary"] == len(cut) and rates["m", None] == len(want)


def test_signs_of_omission_make_no_fragment_a_word_however_many_there_are(spark):
    rng = random.Random(8)
    data = [review(f"ok{n}", " ".join(sentence(rng) for _ in range(3))) for n in range(200)]
    signs = ("…", "...", " [cut]", " (truncated)...")
    data += [review(f"sign{n}", f"{sentence(rng)} The {a} merges the led{signs[n % 4]}", title=f"The {a} hides the win{signs[n % 4]}") for n, a in enumerate(NOUNS)]
    data += [review("cut", "The cursor is kept for 900 days and then sealed. The led", title="The batch maps the win")]
    got = {(r.review_id, r.field): r.reason for r in cut_values(frame(spark, data)).collect()}
    assert {(f"sign{n}", f) for n in range(len(NOUNS)) for f in ("summary", "title")} | {("cut", "summary"), ("cut", "title")} == set(got)
    assert got["cut", "summary"] == got["cut", "title"] == "cut word"


def test_titles_cut_alike_are_no_ends_of_sentences():
    found = truncation.counted([("m", "title", f"The {a} is kept until the second") for a in NOUNS] + [("m", "summary", "It hides the token.")])
    assert ("", "final", "the second") not in found and found["", "final", "the token"] == 1


def test_empty_table(spark):
    assert rows(cut_values(frame(spark, []))) == [] == rows(broken_pairs(frame(spark, [])))


@pytest.mark.parametrize("text,found", [("a `b` c", None), ("a `b", "open code span"), ('say "x', "open quote"), ("f(x", "open bracket"), ("```\nx", "open fence"), ("x \\u00", "broken escape"), ("a &quo", "broken escape"), ("a) b", None), ("it's", None)])
def test_open_marks(text, found):
    assert open_marks(text) == found


def test_code_on_one_line_with_a_comment_is_complete():
    assert code_fault("f(a) { // keep the ) here { return a; }") is None and code_fault("f(a) { // x") is not None
    assert judged("title", "readToken") == (None,) * 5


def test_whole_code_of_other_languages_is_read_by_its_own_lexer():
    python, rust = "def read(x):\n    # it's fine\n    return x", "fn get<'a>(x: &'a str) -> &'a str { x }"
    assert code_fault(python, "Python") is None and code_fault(rust, "rust") is None and code_fault("$a = 'it''", "php")
    assert code_fault("if x:\n    return (x", "python") and code_fault("fn f(x: u8) {", "rs") and code_fault("puts 'x", "ruby") is None
    assert judged("suggested_code", python, "python") == (None,) * 5


def test_cut_values_by_shuffles_and_by_source(spark, monkeypatch):
    rng = random.Random(7)
    data = [review(f"a{n}", " ".join(sentence(rng) for _ in range(3)), model="full") for n in range(200)]
    data += [review(f"b{n}", f"{sentence(rng)} {sentence(rng)[:-1]}", model="bare") for n in range(200)]
    data += [review("cut", "Keep the cursor frozen until the batch has renamed every tok", model="full"), review("nul", "The cursor (see", model=None)]
    whole = sorted((r.review_id, r.field) for r in cut_values(frame(spark, data)).collect())
    assert whole == [("cut", "summary"), ("nul", "summary")]
    monkeypatch.setattr(truncation, "BROADCAST_ROWS", 0)
    assert sorted((r.review_id, r.field) for r in cut_values(frame(spark, data)).collect()) == whole


def test_a_few_reviews_suffice_and_unseen_wordings_are_found(spark):
    prompt, code = prompts(random.Random(1), 5)
    refusals = [
        "Nope, not going to look at this one.", "That falls beyond what this reviewer will engage with.", "This is something I have been told to stay away from.", "I would prefer to leave this request unanswered.",
        "My hands are tied when it comes to code of this sort.", "You'd better find another reviewer for that.", "I am going to sit this one out.", "That kind of help is not what I provide.",
        "We were told that such files are not for us to comment on.", "It isn't my place to judge this code.",
    ]
    foreign = [
        "Pętla odczytuje wartość przy każdym przejściu, chociaż się nie zmienia.", "Döngü, değer değişmediği halde her geçişte onu yeniden okuyor.", "Slingan läser om värdet vid varje varv trots att det inte ändras.",
        "Silmukka lukee arvon uudelleen joka kierroksella, vaikka se ei muutu.", "Smyčka čte hodnotu znovu při každém průchodu, i když se nemění.", "Цикл перечитывает значение при каждом проходе, хотя оно не меняется.",
        "A ciklus minden körben újraolvassa az értéket, pedig az nem változik.", json.dumps({"verdict": "finding", "summary": "Bucla recitește valoarea la fiecare trecere, deși nu se schimbă niciodată."}),
    ]
    usable = ["No issues found.", "The loop reads the value again on every pass although it never changes.", '{"verdict": "skip"}', "LGTM", "I cannot see a reason to copy the list here."]
    texts = {**{f"r{n}": t for n, t in enumerate(refusals)}, **{f"l{n}": t for n, t in enumerate(foreign)}}
    def table(given):
        return frame(spark, [review(i, "x", raw=t, prompt=prompt) for i, t in given.items()])
    got = rows(broken_pairs(table({**texts, "e": " ", "c": code, "t": '{"verdict": "finding", "summary": "The loop re'})))
    assert {x for x in got if x[0] in ("e", "c", "t")} == {("e", "empty"), ("c", "copy"), ("t", "truncated")}
    assert sum((f"l{n}", "language") in got for n in range(len(foreign))) == len(foreign)
    assert sum((f"r{n}", "refusal") in got for n in range(len(refusals))) >= 9
    assert rows(broken_pairs(table({f"u{n}": t for n, t in enumerate(usable)}))) == []


def test_thresholds_lie_inside_a_clean_gap():
    rng = np.random.default_rng(1)
    score = np.concatenate([rng.normal(-8, 1, 900), rng.normal(6, 1, 100)])
    assert -5 < calibrated(score, np.repeat([0.0, 1.0], [900, 100])) < 3


def prompts(rng, n):
    a, b = rng.sample(NOUNS, 2)
    code = f"function {a}{n}({a}, {b}) {{\n  const x{n} = {a} ? {b}.{a} : [{n}, {n} + 1];\n  while ({a}.length > {n}) {{\n    {a}.shift();\n  }}\n  return {b}{n};\n}}"
    return json.dumps({"file": f"src/{a}.ts", "language": "typescript", "qualified_name": f"{a}{n}", "target_function": code}), code


def test_defects_of_pairs(spark):
    rng = random.Random(8)
    data, truth = [], set()

    def answer(text):
        body = {"verdict": "finding", "severity": "low", "title": "Unchecked cursor", "summary": text, "issues": [{"category": "x", "description": sentence(rng)}], "suggested_code": None}
        return rng.choice(["%s", "```json\n%s\n```", "Here is my review of the function.\n\n%s"]) % json.dumps(body, ensure_ascii=False)

    def add(raw, *defects):
        prompt, _ = prompt_code
        i = f"r{len(data)}"
        data.append(review(i, sentence(rng), raw=raw, prompt=prompt))
        truth.update((i, d) for d in defects)

    for n in range(400):
        prompt_code = prompts(rng, n)
        add(rng.choice([answer(" ".join(sentence(rng) for _ in range(3))), " ".join(sentence(rng) for _ in range(3))]))
    for n in range(12):
        prompt_code = prompts(rng, 1000 + n)
        code = prompt_code[1]
        add(rng.choice(["", " ", "null", "{}", "\u200b", '{"verdict": null, "summary": ""}']), "empty")
        full = answer(" ".join(sentence(rng) for _ in range(3)))
        add(full[full.index("{") : len(full) // 2], "truncated")
        add(rng.choice(["Regrettably, this is not something I am able to review. My policies forbid it.", "I'm sorry, I won't be analysing the given code.", "This request is declined and no answer will be given."]), "refusal")
        add(rng.choice([code, " ".join(code.split()), f"```ts\n{code}\n```", prompt_code[0], f"Function x:\n\n{code}"]), "copy")
        add(rng.choice(["Der Wert wird bei jedem Lauf neu gelesen, obwohl er sich nicht geändert hat.", "La valeur est relue à chaque passage, même si elle n'a pas changé.", "値を毎回読み直すため、処理が遅くなります。", answer("El valor se vuelve a leer en cada pasada aunque no haya cambiado y el bucle no termina nunca.").replace("Unchecked cursor", "valor")]), "language")
        add('{"verdict": "skip", "severity": "none"}')
        add(" ".join(sentence(rng) for _ in range(3)) + ' Sorry paths such as `throw new Error("cannot help")` are covered.')
    data.append(review("null", "x", raw=None))
    got = set(rows(broken_pairs(frame(spark, data + data[:40]))))
    hit = got & truth
    missed = {(i, d) for i, d in truth - got if d != "language" or "El valor" not in str(data)}
    assert len(hit) / len(truth) > 0.9 and len(hit) / len(got) > 0.9, (sorted(missed)[:9], sorted(got - truth)[:9])
    for kind in ("empty", "truncated", "refusal", "copy", "language"):
        of = {t for t in truth if t[1] == kind}
        assert len(of & got) / len(of) > 0.7, kind


def test_each_word_of_an_answer_is_looked_up_once():
    from zlib import crc32

    from orefield.llm.pairs import DENSE, DIMS, USUAL, Features, word_bin

    class Counted(Features):
        calls = 0

        def word(self, word):
            Counted.calls += 1
            return super().word(word)

    share = np.zeros(1 << 16, np.float32)
    share[[word_bin(w) for w in ("the", "cursor", "is", "read", "again")]] = 0.5
    text = "The cursor isn’t read again.\nDer Wert wird über readToken erneut gelesen.\n\nThe THE caf\u00e9 is read."
    grams, dense = Counted(share).of("the cursor is read", text, False)
    words = ["the", "cursor", "isn't", "read", "again", "der", "wert", "wird", "über", "erneut", "gelesen", "the", "the", "café", "is", "read"]
    h = [crc32(w.encode()) for w in words]
    pairs = [a * 31 + b + 7 for a, b in zip(h, h[1:])]
    chars = [crc32(f"<{w}>"[i : i + n].encode()) for w in words for n in (3, 4) for i in range(len(w) + 3 - n)]
    assert grams.tolist() == sorted({x % DIMS for x in [*h, *pairs, *(a * 31 + b + 13 for a, b in zip(pairs, h[2:])), *chars]})
    d = dict(zip(DENSE, dense.tolist()))
    found = [share[word_bin(w)] for w in words]
    told = {"non_ascii": 2, "unknown": sum(x < USUAL for x in found), "common": sum(x >= 0.05 for x in found), "own": sum(w in "the cursor is read" for w in words)}
    assert {k: round(d[k] * len(words), 3) for k in told} == told and d["strange"] == 1 and d["cjk"] == 0
    assert Counted.calls == len(words) + 1  # and the name in camel case


def test_parsed_shapes():
    assert parsed('```json\n{"a": 1}\n```')[0] == "json" and parsed('{"a": ')[0] == "broken" and parsed("plain {x} text")[0] == "text" and parsed("null")[1] is None
