"""Broken prompt and response pairs.

Method: a multi-label linear classifier on hashed n-grams of the answer (words and characters) and features
of the pair, among them how usual the answer's words are in the table's own answers. It is trained on
responses of the table and on synthetic truncated, copied, swapped, refused, empty and foreign ones made from
them and from phrases; each label's threshold is calibrated on examples kept aside.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from orefield.llm.truncation import CJK, held_against, open_marks, text_baselines
from orefield.session import stored

LABELS = ("empty", "truncated", "refusal", "copy", "language")
#: Fitting: at most so many reviews, chosen by a hash of their ids, and so many seeds of phrases; each gives several
#: examples.
TRAIN_ROWS, PHRASE_SEEDS = 1_500, 400
#: Hashed features, passes of the fit, examples a step, step and penalty.
DIMS, EPOCHS, BATCH, STEP, PENALTY = 1 << 16, 8, 256, 0.3, 1e-5  # a feature's number has 16 bits
#: Share of the examples kept aside for the thresholds.
ASIDE = 0.3
#: A word in fewer than this share of the answers counts as unknown, so that answers in another language don't make
#: their words known.
USUAL = 0.01
#: Words are counted in so many bins.
BINS = 1 << 16

# Phrases for synthetic examples: refusals are put together from parts, so are answers of few words that are none.
WHO = ("I", "I", "I", "We", "This assistant", "This reviewer", "This model", "The assistant", "This tool")
UNABLE = (
    "can't", "cannot", "can not", "won't", "will not", "am not able to", "am unable to", "am not allowed to", "am not permitted to", "am not going to", "decline to", "refuse to", "must decline to",
    "have to decline to", "would rather not", "prefer not to", "do not wish to", "have been told not to", "have been instructed not to", "was asked not to", "am forbidden to", "shouldn't", "don't want to",
    "have no permission to", "choose not to", "do not intend to", "am in no position to", "must refrain from trying to", "will have to pass on the request to", "feel uncomfortable to", "no longer",
)
DO = (
    "look at", "review", "assess", "judge", "comment on", "engage with", "examine", "discuss", "help with", "assist with", "analyse", "evaluate", "answer", "work on", "go into", "give an opinion on", "say anything about",
    "take part in", "touch", "deal with", "respond to", "process", "provide feedback on", "continue with", "read", "handle", "inspect", "be of help with", "offer advice on", "share my view of",
)
WHAT = ("this", "this one", "that", "this code", "this function", "the request", "your request", "it", "such material", "this kind of code", "the given source", "this input", "the submitted code", "requests like this", "this topic", "this file", "what you sent")
IMPERSONAL = (
    "This falls {beyond} what {who} {may} {do}", "That lies {beyond} what {who} {may} {do}", "{What} is something {who} {told} stay away from", "{What} is something {who} {told} avoid", "{What} goes against {rules}",
    "{rules} {forbid} {doing} {what}", "{Doing} {what} is not {allowed}", "{What} cannot be {done} here", "{What} will not be {done}", "No {opinion} will be given on {what}", "There will be no {opinion} from {whom} on {what}",
    "It is not possible for {whom} to {do} {what}", "{What} has been {denied}", "{What} is {denied}", "Nothing can be said about {what}", "{What} isn't eligible for {opinion}", "{rules} keep {whom} from {doing} {what}",
    "Please ask someone else to {do} {what}", "Someone else should {do} {what}, not {whom}", "Count {whom} out of {doing} {what}", "Nope, not {doing} {what}", "No, {who} {unable} {do} {what}", "Not going to {do} {what}", "Not able to {do} {what}",
    "Request {denied}: {what} is not {allowed}", "{Denied}: {what} is not eligible for {opinion}", "The content is not eligible for {opinion}", "Sorry, no", "I must pass", "No comment on {what}", "Request denied", "{Doing} {what} is out of the question", "Leave {whom} out of {what}", "You will have to find another way to {do} {what}", "My answer to {what} is no answer at all",
)
SLOTS = {
    "beyond": ("beyond", "outside of", "outside", "out of the scope of", "well outside", "past"), "may": ("may", "can", "will", "am able to", "am willing to", "is willing to", "is allowed to", "should", "is meant to"), "told": ("have been told to", "was told to", "am supposed to", "am instructed to", "have to", "need to", "must", "have been asked to"),
    "rules": ("My guidelines", "My instructions", "The rules", "The policy", "My policy", "Safety rules", "The guidelines I follow", "The terms of use", "My training", "Company policy", "The conditions of service"),
    "forbid": ("forbid", "do not allow", "don't permit", "prohibit", "prevent me from", "rule out", "stop me from", "do not cover", "keep me from"),
    "doing": ("looking at", "reviewing", "assessing", "commenting on", "discussing", "examining", "answering", "helping with", "going over", "touching", "judging", "giving feedback on", "working on"),
    "done": ("reviewed", "processed", "assessed", "examined", "discussed", "answered", "looked at", "evaluated", "handled", "commented on", "judged"), "allowed": ("allowed", "permitted", "possible for me", "something I do", "my job", "within my remit", "on offer", "what I am here for"),
    "opinion": ("opinion", "review", "assessment", "comment", "feedback", "answer", "verdict", "analysis"), "denied": ("denied", "declined", "refused", "rejected", "blocked", "off limits", "out of bounds", "not supported", "turned down"), "whom": ("me", "us", "this assistant", "this reviewer", "this model"),
}
BEFORE = ("I'm sorry, but", "Sorry,", "I apologize, but", "Apologies,", "Unfortunately,", "As an AI model,", "As a language model,", "Thank you, however", "Regrettably,", "I'm afraid", "With regret,", "To be clear,", "", "", "", "", "")
AFTER = ("", "", "", ".", ".", ". Please ask something else.", ". Please consult an expert.", ". It may contain sensitive material.", ". Let me know if I can help with another topic.", ". Feel free to ask about other things.", ". Thanks for understanding.", ". Try another tool.", ". That is final.", ", for reasons of policy.", ", so I will stop here.")
CLAIMS = (
    "No issues found", "Looks good to me", "The function is fine", "Nothing to report", "No finding", "The code is correct and readable", "LGTM", "Consider adding a test", "No concerns", "The function could be shorter",
    "I found no problem in {what}", "The loop is correct", "I looked at {what} and saw no bug", "I would not change {what}", "The caller cannot pass null here", "This can't fail", "It won't overflow", "I don't see a defect", "No, the check is right",
    "I can't reproduce a failure and the guard holds", "The value isn't used after the return", "Reviewed, nothing stands out", "{What} is safe to merge", "The function will not return until the queue is empty", "We should not swallow the error here",
    "The index may not be negative", "I reviewed {what} and it does what its name says", "There is no need to copy the array", "Sorry paths are covered by tests", "The token expires twice when the clock moves", "Guests get no access, which is right",
    "The policy object is read once", "The rules are applied in order", "Please rename the variable", "I suggest to validate the input first", "The handler should skip empty lists", "The lock prevents two writers from going on", "One branch is never taken", "It is possible that the list is empty",
    "The reader stops at the first blank line, so trailing records are lost", "The counter is reset before it is read", "Use a constant for the limit", "skip", "finding", "ok", "fine", "none", "The result should be computed once and passed on", "If the list is empty, the function never ends",
    "The loop reads the value again in each pass although it doesn't change", "It would be better to close the file when an error is thrown", "Each call opens a new connection and memory grows with the number of users", "The error message doesn't say which key was missing",
)
FOREIGN = (
    "Die Schleife liest den Wert mehrfach, obwohl er sich nicht ändert.", "Es wäre besser, das Ergebnis einmal zu berechnen und weiterzugeben.", "Wenn die Liste leer ist, endet die Funktion nicht.",
    "La boucle relit la valeur à chaque passage, même si elle ne change pas.", "Il vaudrait mieux calculer le résultat une seule fois.", "Quand la liste est vide, la fonction ne se termine jamais.",
    "El bucle vuelve a leer el valor en cada pasada aunque no cambie.", "Sería mejor calcular el resultado una sola vez.", "Si la lista está vacía, la función no termina nunca.",
    "O laço lê o valor a cada passagem, embora ele não mude.", "Seria melhor calcular o resultado uma única vez.", "Se a lista estiver vazia, a função não termina.",
    "ループは毎回値を読み直すため、処理が遅くなります。", "結果を一度だけ計算する方が安全です。", "循环每次都会重新读取该值，即使没有变化。", "建议只计算一次结果。",
    "Il ciclo rilegge il valore a ogni passaggio anche se non cambia.", "Sarebbe meglio calcolare il risultato una sola volta.", "De lus leest de waarde steeds opnieuw, ook als die niet verandert.",
)
FOREIGN_REFUSALS = (
    "Es tut mir leid, aber ich kann diese Funktion nicht prüfen.", "Diese Anfrage kann ich leider nicht beantworten.", "Je suis désolé, mais je ne peux pas examiner ce code.",
    "Je ne peux pas répondre à cette demande.", "Lo siento, pero no puedo revisar esta función.", "No puedo ayudar con esta solicitud.",
    "Desculpe, mas não posso analisar esta função.", "Não posso ajudar com este pedido.", "申し訳ありませんが、この関数は確認できません。", "抱歉，我无法审查这个函数。",
    "Mi dispiace, ma non posso esaminare questa funzione.", "Het spijt me, maar ik kan deze functie niet beoordelen.",
)
EMPTY = ("", " ", "\n", "\n\n", "null", '""', "[]", "{}", "```\n```", "```json\n{}\n```", "​", "...", "None", "N/A", '{"verdict": null, "summary": "", "issues": []}', '{"verdict":null,"issues":[],"summary":null}', "-", '{"title": "", "summary": ""}')

TOKEN = re.compile(r"[^\W_]+|[^\w\s]")
WORD = re.compile(r"[^\W\d_][\w'’]*")
CAMEL = re.compile(r"[a-z][A-Z]")
CHARACTER = re.compile(r"[^\s​-‏﻿\"'{}\[\]`.,:;-]")
FENCE = re.compile(r"^```[\w-]*[ \t]*\n?|\n?```[ \t]*$")
CODE_SPAN = re.compile(r"```.*?```|`[^`]*`|\"[^\"]{0,200}\"|„[^“”]*[“”]|“[^”]*”", re.DOTALL)
JSON_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"\s*([:,}\]]|$)')
LABEL_KEYS = frozenset("verdict severity confidence needs_broader_context category".split())
INPUT_KEYS = frozenset("file target_function qualified_name content_hash local_context start_line end_line".split())
DENSE = (
    "one", "no_word", "no_char", "verdict", "json_open", "json_bad", "fence_open", "marks_open", "cut_prose", "no_end", "inside", "inside_all", "looks_code",
    "cjk", "non_ascii", "short", "prose", "input_keys", "brief", "usual", "unknown", "common", "strange", "own",
)


def parsed(raw: str):
    """(kind, object or None, body): 'json', 'broken' for JSON that doesn't end, 'text' otherwise."""
    body = FENCE.sub("", raw.strip()).strip()
    start = body.find("{")
    if start < 0 or (start > 0 and not re.search(r"[:.\n]\s*$", body[:start])):
        try:
            value = json.loads(body)
            return "json", value, body
        except ValueError:
            return "text", None, body
    try:
        value, end = json.JSONDecoder().raw_decode(body[start:])
        return "json", value, body
    except ValueError:
        return ("broken" if re.match(r'\{\s*"', body[start:]) else "text"), None, body


def strings(value, key: str = "") -> Iterator[str]:
    if isinstance(value, str):
        if key not in LABEL_KEYS and value:
            yield value
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from strings(v, k)
    elif isinstance(value, list):
        for v in value:
            yield from strings(v, key)


class Features:
    """Numbers of a pair: indices of hashed n-grams of the answer's prose, and dense features. ``share`` is how
    many of the table's answers hold a word of each bin."""

    def __init__(self, share: np.ndarray) -> None:
        self.usual = np.log10(np.maximum(share, USUAL)) / -np.log10(USUAL) + 1
        self.share = share
        self.known: dict[str, tuple[str, bool, int, int, np.ndarray] | None] = {}

    def word(self, word: str) -> tuple[str, bool, int, int, np.ndarray] | None:
        """(form, whether beyond ASCII, hash, bin, features of the character n-grams) of a word as it is written;
        none for a name in camel case."""
        found = self.known.get(word, ())
        if found == ():
            if len(self.known) > 200_000:
                self.known.clear()
            form = word.lower().replace("’", "'")
            edged = f"<{form}>"
            grams = [crc32(edged[i : i + n].encode()) % DIMS for n in (3, 4) for i in range(len(edged) - n + 1)] if len(form) < 40 else []
            found = None if CAMEL.search(word) else (form, not form.isascii(), crc32(form.encode()), word_bin(form), np.array(grams, np.uint16))
            self.known[word] = found
        return found

    def of(self, prompt: str | None, raw: str, cut: bool) -> tuple[np.ndarray, np.ndarray]:
        kind, value, body = parsed(raw)
        d = dict.fromkeys(DENSE, 0.0)
        d["one"] = 1.0
        if kind == "json" and isinstance(value, dict) and not INPUT_KEYS & value.keys():
            d["verdict"] = float(isinstance(value.get("verdict"), str) and bool(value["verdict"].strip()))
            text = "\n".join(strings(value))
        elif kind == "json":
            d["input_keys"] = float(isinstance(value, dict) and len(INPUT_KEYS & value.keys()) >= 3)
            text = body if isinstance(value, (dict, list)) and value else value if isinstance(value, str) else ""
        elif kind == "broken":
            d["json_open"] = 1.0
            d["verdict"] = float('"verdict"' in body)
            text = "\n".join(m[1] for m in JSON_STRING.finditer(body) if m[2] != ":") or body
        else:
            text = body
        fences = raw.count("```")
        d["fence_open"] = float(fences % 2)
        tokens = TOKEN.findall(text)
        if kind == "text" and tokens:
            d["marks_open"] = float(open_marks(text) is not None)
            d["no_end"] = float(d["marks_open"] > 0 or len(tokens) >= 4 and text.rstrip()[-1:] not in tuple(".!?。！？}`)\"”;"))
        d["cut_prose"] = float(cut)
        source = prompt or ""
        d["inside"], looks = self.inside(tokens, source)
        d["looks_code"] = looks
        # Nothing but the input: all of the answer stands in it, in its order of tokens.
        d["inside_all"] = float(d["inside"] >= 0.93 and len(tokens) >= 6)
        prose = "" if d["inside"] > 0.8 or looks else CODE_SPAN.sub(" ", text)
        lines = [[t for w in WORD.findall(p) if (t := self.word(w)) is not None] for p in prose.split("\n")]
        told = [t for line in lines for t in line]
        n = len(told)
        cjk = 0 if prose.isascii() else len(CJK.findall(prose))
        d["no_word"] = float(not tokens or not any(t[0].isalnum() for t in tokens) or text.strip().lower() in ("null", "none", "n/a"))
        d["no_char"] = float(not CHARACTER.search(text))
        d["short"] = float(0 < n < 4)
        d["prose"] = float(n >= 4)
        d["cjk"] = float(cjk > 0 and cjk > 0.3 * max(1, len(re.sub(r"\s", "", prose))))
        if not n:
            return np.zeros(0, np.int64), np.array([d[k] for k in DENSE], np.float32)
        forms, beyond, hashes, bins, _ = zip(*told)
        bins = np.array(bins)
        share = self.share[bins]
        d["non_ascii"] = sum(beyond) / n
        d["brief"] = float(n < 40)
        d["own"] = sum(map(source.__contains__, forms)) / n
        if n >= 4:  # fewer words tell nothing of their language
            rare, common = share < USUAL, share >= 0.05
            d["usual"] = float(self.usual[bins].mean())
            d["unknown"] = np.count_nonzero(rare) / n
            d["common"] = np.count_nonzero(common) / n
            # One part in another language counts, also beside English ones.
            ends = np.cumsum([len(line) for line in lines]).tolist()
            parts = [(end - len(line), end) for line, end in zip(lines, ends) if len(line) >= 6] or [(0, n)]
            d["strange"] = float(any(np.count_nonzero(common[a:b]) / (b - a) < 0.2 and np.count_nonzero(rare[a:b]) / (b - a) > 0.4 for a, b in parts))
        h = np.array(hashes, np.int64)
        pairs = h[:-1] * 31 + h[1:] + 7
        runs = np.concatenate([h, pairs, pairs[:-1] * 31 + h[2:] + 13]) % DIMS
        grams = np.sort(np.concatenate([runs.astype(np.uint16), *{t[0]: t[4] for t in told}.values()]))
        first = np.ones(len(grams), bool)
        np.not_equal(grams[1:], grams[:-1], out=first[1:])
        return grams[first].astype(np.int64), np.array([d[k] for k in DENSE], np.float32)

    @staticmethod
    def inside(tokens: list[str], source: str) -> tuple[float, float]:
        """Share of the answer's runs of five tokens that occur in the input, and whether it looks like code."""
        body = tokens
        if len(body) > 3 and body[0].lower() in ("function", "input", "code", "source") and ":" in body[:8]:
            body = body[body.index(":") + 1 :]
        looks = float(len(body) > 10 and sum(map("{}();=".__contains__, body)) > 0.12 * len(body))
        if len(body) < 5:
            text = "".join(body).lower()
            return float(bool(text) and len(text) > 3 and text in re.sub(r"\W|_", "", source).lower() and len(body) <= 2 and len(text) > 12), looks
        try:
            fields = json.loads(source)
        except ValueError:
            fields = None
        texts = [str(v) for v in fields.values()] if isinstance(fields, dict) else [source]
        plain = " ".join([*texts, *fields]) if isinstance(fields, dict) else source
        distinct = set(body)
        # Runs can only stand in the input if their tokens do; most answers end here.
        if len(distinct.intersection(TOKEN.findall(plain))) < 0.6 * len(distinct):
            return 0.0, looks
        forms = [source, *texts]
        if isinstance(fields, dict):
            forms.append("\n".join(f"{k}: {v}" for k, v in fields.items()))
        known = {tuple(t[i : i + 5]) for t in map(TOKEN.findall, forms) for i in range(len(t) - 4)}
        runs = len(body) - 4
        return sum(tuple(body[i : i + 5]) in known for i in range(runs)) / runs, looks


def word_bin(word: str) -> int:
    """The bin in which a word is counted: the engine's own hash of it."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 42) % BINS


def phrase(rng: random.Random, pattern: str) -> str:
    """A pattern with its slots filled at random."""
    def fill(m: re.Match) -> str:
        name = m[1].lower()
        found = rng.choice({"who": WHO, "unable": UNABLE, "do": DO, "what": WHAT}.get(name) or SLOTS[name])
        return found[0].upper() + found[1:] if m[1][0].isupper() else found
    return re.sub(r"\{(\w+)\}", fill, pattern)


def refusal(rng: random.Random, pick) -> str:
    pattern = f"{rng.choice(WHO)} {pick(UNABLE)} {pick(DO)} {rng.choice(WHAT)}" if rng.random() < 0.5 else pick(IMPERSONAL)
    text = phrase(rng, pattern)
    before = rng.choice(BEFORE)
    if before and not text.startswith("I "):
        text = text[0].lower() + text[1:]
    text = f"{before} {text}".strip() + rng.choice(AFTER)
    if rng.random() < 0.3:
        text += ("" if text[-1] == "." else ".") + " " + phrase(rng, pick(IMPERSONAL)) + "."
    return text[0].upper() + text[1:]


def ciphered(rng: random.Random, text: str) -> str:
    """The text in a language that nobody speaks: vowels and consonants are exchanged among themselves, some words
    get other lengths, and some letters marks."""
    vowels, rest = list("aeiou"), list("bcdfghjklmnpqrstvwxyz")
    to = dict(zip("aeiou", rng.sample(vowels, 5))) | dict(zip("bcdfghjklmnpqrstvwxyz", rng.sample(rest, 21)))
    if rng.random() < 0.6:
        to[rng.choice(vowels)] = rng.choice("äöüåéíőýăąęığ")
        to[rng.choice(rest)] = rng.choice("şčřłžğñçß")
    ends = rng.choices(("", "", "a", "en", "ur", "i", "ka", "lar", "os", "ta"), k=4)
    return " ".join("".join(to.get(c, c) for c in w.lower()) + (ends[len(w) % 4] if w.isalpha() and len(w) > 2 else "") for w in text.split())


def synthetic(identity: str, prompt: str | None, raw: str | None, other: str | None, aside: bool) -> list[tuple[str, tuple[str, ...], bool]]:
    """(response, labels, whether it is one of the table's) made from one pair, or from phrases alone where
    ``raw`` is null; reproducibly. Examples kept aside are made of phrases that the others don't
    use, so the thresholds hold for unseen wordings."""
    rng = random.Random(crc32(identity.encode()))

    def pick(phrases):
        return rng.choice([p for i, p in enumerate(phrases) if (i % 3 == 0) == aside])

    def dressed(text: str, beside: bool = False) -> str:
        layout = rng.random()
        if layout < 0.4:
            return text
        found = {"verdict": "skip", "severity": "none", "confidence": "low", "title": text[: rng.choice((30, 60, 200))].split(".")[0], "summary": text, "issues": [], "suggested_code": None, "assumptions": []}
        if beside and rng.random() < 0.4:
            found |= {"title": phrase(rng, pick(CLAIMS)), "issues": [{"category": "bug", "description": claims(1)}]}
        return ("```json\n%s\n```" if layout > 0.7 else "%s") % json.dumps(found, ensure_ascii=False)

    def claims(n: int) -> str:
        return " ".join(phrase(rng, pick(CLAIMS)) + "." for _ in range(n))

    made: list[tuple[str, tuple[str, ...], bool]] = []
    if raw is not None:
        made += [(raw, (), True), (other, (), True)]  # the own and a swapped one
    else:
        raw = dressed(claims(rng.choice((2, 3, 5))))
        made.append((raw, (), False))
    kind, _, body = parsed(raw)
    if len(raw) > 40:
        text = raw[: rng.randrange(len(raw) // 10, len(raw) - 2)]
        if not (kind == "text" and re.search(r"[.!?]\s*$", text)):
            made.append((text, ("truncated",), False))
    made.append((rng.choice(EMPTY), ("empty",), False))
    made.append((dressed(refusal(rng, pick)), ("refusal",), False))
    own = " ".join(strings(parsed(raw)[1])) if kind == "json" else body if kind == "text" else ""
    told = CODE_SPAN.sub(" ", own) if len(own.split()) > 5 and rng.random() < 0.5 else claims(rng.choice((1, 2, 3)))
    made.append((dressed(ciphered(rng, " ".join(told.split()[: rng.choice((6, 12, 40))])), True), ("language",), False))
    if rng.random() < 0.5:
        tongue = rng.randrange(0, len(FOREIGN) - 3)
        made.append((dressed(" ".join(pick(FOREIGN[tongue : tongue + 4]) for _ in range(rng.choice((1, 2, 3))))), ("language",), False))
    if rng.random() < 0.25:
        made.append((dressed(pick(FOREIGN_REFUSALS)), ("refusal", "language"), False))
    if kind == "text" and rng.random() < 0.7:  # whole answers needn't have a stop
        made.append((body.rstrip(".!?") + rng.choice(("", "", "\n- one\n- two")), (), False))
    for _ in range(2):
        short = phrase(rng, pick(CLAIMS))
        made.append((dressed(short + rng.choice(("", "", ".", "!"))), (), False))
    if rng.random() < 0.4:
        made.append((json.dumps({"verdict": rng.choice(("skip", "finding")), "severity": "none"}), (), False))
    try:
        code = json.loads(prompt or "")["target_function"]
    except (ValueError, KeyError, TypeError):
        code = None
    if isinstance(code, str) and len(code) > 30:
        copy = (
            code, re.sub(r"\s+", " ", code), "\n".join(x.strip() for x in code.split("\n")), f"```js\n{code}\n```", prompt,
            json.dumps({"verdict": "skip", "severity": "none", "title": "copy", "summary": code, "issues": []}),
        )[rng.randrange(6)]
        made.append((copy, ("copy",), False))
    return made


# Fitting


def phrase_pair(n: int) -> tuple[str, str]:
    """(id, prompt) of a made-up pair, for the examples of phrases alone."""
    rng = random.Random(n)
    a, b, c = (rng.choice(WHAT).split()[-1] + str(rng.randrange(99)) for _ in range(3))
    code = f"function {a}({b}) {{\n  const {c} = {b}.length > {n} ? {b}[{n}] : {b};\n  while ({c}) {{ {b}.push({c}); }}\n  return {c};\n}}"
    return f"phrase {n}", json.dumps({"file": f"{a}.js", "language": "javascript", "target_function": code})


class Examples:
    """Rows of a fit: sparse n-grams as one flat row, dense features, truth, and what is kept aside or real."""

    def __init__(self, grams: pa.ListArray, dense: np.ndarray, truth: np.ndarray) -> None:
        self.flat = grams.values.to_numpy()
        self.begin = grams.offsets.to_numpy().astype(np.int64)
        self.size = np.diff(self.begin)
        self.dense, self.truth = dense, truth

    def part(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n-grams, row of each, weight of each): the n-grams of a text share one unit of weight."""
        size = self.size[rows]
        owner = np.repeat(np.arange(len(rows)), size)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + self.begin[rows][owner]
        return self.flat[at], owner, 1 / np.sqrt(np.maximum(size, 1))[owner]


def descend(rows: Examples, train: np.ndarray, sparse: bool) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression by stochastic descent with per-weight steps (Adagrad): weights of n-grams and of
    dense features. Both classes weigh alike."""
    rng = np.random.default_rng(3)
    hashed, dense = np.zeros(DIMS), np.zeros(rows.dense.shape[1])
    seen_h, seen_d = np.full(DIMS, 1e-2), np.full(len(dense), 1e-2)
    share = min(max(rows.truth[train].mean(), 0.02), 0.98)
    weight = np.where(rows.truth > 0, 0.5 / share, 0.5 / (1 - share))
    parts = [(p, *rows.part(p)) if sparse else (p,) for p in np.array_split(rng.permutation(train), max(1, len(train) // BATCH))]
    for _ in range(EPOCHS if sparse else 3 * EPOCHS):
        for n in rng.permutation(len(parts)):
            part = parts[n][0]
            x = rows.dense[part]
            score = x @ dense
            if sparse:
                _, flat, owner, scale = parts[n]
                score = score + np.bincount(owner, hashed[flat] * scale, len(part))
            error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - rows.truth[part]) * weight[part] / len(part)
            g = x.T @ error + PENALTY * dense
            seen_d += g * g
            dense -= STEP * g / np.sqrt(seen_d)
            if sparse:
                g = np.bincount(flat, error[owner] * scale, DIMS) + PENALTY * hashed
                seen_h += g * g
                hashed -= STEP * g / np.sqrt(seen_h)
    return hashed, dense


def calibrated(score: np.ndarray, truth: np.ndarray) -> float:
    """The score at which both answers are equally probable: a logistic curve fitted to the examples kept
    aside, with smoothed targets so that a clean gap has its bound inside."""
    yes, no = max(1.0, truth.sum()), max(1.0, (1 - truth).sum())
    target = np.where(truth > 0, (yes + 1) / (yes + 2), 1 / (no + 2))
    weight = np.full(len(score), 1 / max(1, len(score)))
    a, b = 1.0, -float(score[truth > 0].mean() + score[truth == 0].mean()) / 2 if 0 < truth.sum() < len(truth) else 0.0
    for _ in range(200):  # Newton steps, damped
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        g = np.array([np.sum(weight * (p - target) * score) + 1e-6 * a, np.sum(weight * (p - target))])
        curve = weight * p * (1 - p) + 1e-12
        h = np.array([[np.sum(curve * score * score) + 1e-6, np.sum(curve * score)], [np.sum(curve * score), np.sum(curve) + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0] * min(1, 0.5 / max(1e-9, np.abs(step).max())), b - step[1] * min(1, 0.5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return -b / a if a > 1e-3 else float("inf")


def fit_label(table: pa.Table) -> pa.Table:
    """One label's weights and threshold. A first fit on the dense features alone finds responses of the table
    that aren't the usable ones they are taken for; the second leaves them out."""
    table = table.sort_by([("id", "ascending"), ("number", "ascending")])
    label = table.column("label")[0].as_py()
    dense = np.array(table.column("dense").to_pylist(), np.float64)
    truth = (table.column("labels").to_numpy() >> label & 1).astype(np.float64)
    aside, real = table.column("aside").to_numpy(), table.column("own").to_numpy()
    grams = table.column("grams").combine_chunks()
    rows = Examples(grams, dense, truth)
    _, rough = descend(rows, np.flatnonzero(~aside), False)
    doubtful = real & (dense @ rough > 0)
    hashed, weights = descend(rows, np.flatnonzero(~aside & ~doubtful), True)
    held = np.flatnonzero(aside & ~doubtful)
    flat, owner, scale = rows.part(held)
    score = dense[held] @ weights + np.bincount(owner, hashed[flat] * scale, len(held))
    found = [label], [hashed.astype(np.float32).tobytes()], [weights.astype(np.float32).tobytes()], [calibrated(score, truth[held])]
    return pa.table([pa.array(c, k) for c, k in zip(found, (pa.int32(), pa.binary(), pa.binary(), pa.float64()))], names=["label", "hashed", "dense", "threshold"])


class Model:
    """Weights over hashed and dense features for every label, and thresholds on the log-odds."""

    def __init__(self, hashed: np.ndarray, dense: np.ndarray, threshold: np.ndarray) -> None:
        self.hashed, self.dense, self.threshold = hashed, dense, threshold

    def scores(self, grams: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        sizes = np.array([len(g) for g in grams])
        out = dense @ self.dense
        if sizes.sum():
            flat = np.concatenate(grams)
            begin = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[begin]
            out[begin] += np.add.reduceat(self.hashed[flat], starts, axis=0) / np.sqrt(sizes[begin])[:, None]
        return out


def word_shares(pairs: DataFrame) -> np.ndarray:
    """Share of all answers that hold a word of each bin. The phrases of the synthetic examples count as answers
    too, and are a sample of their own, so English is known in a small table and where refusals are rare. The
    result has BINS numbers, whatever the table."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.lower(F.replace("raw_response", F.lit("’"), F.lit("'"))), F.lit(r"([\p{L}][\p{L}\p{N}_']*)"), F.lit(1)), lambda w: F.pmod(F.xxhash64(w), F.lit(BINS)).cast("int")))
    found = pairs.select(F.explode(words).alias("bin")).groupBy("bin").agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(BINS)
    counts[found.column("bin").to_numpy()] = found.column("n").to_numpy()
    rng = random.Random(5)
    texts = [phrase(rng, c) for c in (*CLAIMS, *IMPERSONAL) for _ in range(3)] + [refusal(rng, rng.choice) for _ in range(300)]
    made = np.zeros(BINS)
    for text in texts:
        made[list({word_bin(w) for w in WORD.findall(text.lower())})] += 1
    return np.maximum((counts + made) / (pairs.count() + len(texts)), made / len(texts)).astype(np.float32)


def cut_prose(pairs: DataFrame, baselines: DataFrame) -> DataFrame:
    """(id, cut) of the answers in prose that are cut by the baselines of problem 4."""
    prose = ~F.col("raw_response").rlike(r"^\s*(```|[\[{])")
    values = pairs.where(prose).select("id", F.lit("").alias("model"), F.lit("summary").alias("field"), F.col("raw_response").alias("text"), F.lit(None).cast("string").alias("language"))
    return held_against(values, baselines).where("reason is not null").select(F.col("review_id").alias("id"), F.lit(True).alias("cut"))


def fit(spark: SparkSession, pairs: DataFrame, baselines: DataFrame, share: np.ndarray) -> Model:
    """The classifier, fitted on a bounded sample: examples and their features are made in tasks, each label is
    fitted in one."""
    schema = "id string, of string, number int, input_json string, raw_response string, labels int, aside boolean, own boolean"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prompts, raws = (c.to_pylist() for c in batch.columns)
            rows = []
            for i, (name, prompt, raw) in enumerate(zip(ids, prompts, raws)):
                aside = crc32(name.encode()) % 100 < 100 * ASIDE
                for n, (text, names, own) in enumerate(synthetic(name, prompt, raw, raws[(i + 1) % len(raws)], aside)):
                    rows.append((f"{n} {name}", name, n, prompt, text, sum(1 << LABELS.index(x) for x in names), aside, own))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=[c.split()[0] for c in schema.split(", ")])

    few = pairs.where(F.length("raw_response") > 40).orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS).repartition(24, "id")
    phrases = spark.createDataFrame([(*phrase_pair(n), None) for n in range(PHRASE_SEEDS)], "id string, input_json string, raw_response string").repartition(8, "id")
    examples = stored(few.select("id", "input_json", "raw_response").mapInArrow(make, schema).unionByName(phrases.mapInArrow(make, schema)))
    told = examples.join(cut_prose(examples, baselines), "id", "left").repartition(24, "id")
    held = spark.sparkContext.broadcast(share)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(held.value)
        for batch in batches:
            found = [features.of(p, r, bool(c)) for p, r, c in zip(*(batch.column(c).to_pylist() for c in ("input_json", "raw_response", "cut")))]
            grams = pa.array([g.astype(np.int32) for g, _ in found], pa.list_(pa.int32()))
            dense = pa.array([d for _, d in found], pa.list_(pa.float32()))
            keep = [batch.column(c) for c in ("of", "number", "labels", "aside", "own")]
            yield pa.RecordBatch.from_arrays([*keep, grams, dense], names=["id", "number", "labels", "aside", "own", "grams", "dense"])

    rows = told.mapInArrow(number, "id string, number int, labels int, aside boolean, own boolean, grams array<int>, dense array<float>")
    by_label = rows.withColumn("label", F.explode(F.array(*[F.lit(k) for k in range(len(LABELS))]))).repartition(16, "label").groupBy("label")
    found = by_label.applyInArrow(fit_label, "label int, hashed binary, dense binary, threshold double").orderBy("label").collect()  # one row a label
    hashed, dense = (np.stack([np.frombuffer(r[c], np.float32) for r in found], 1) for c in ("hashed", "dense"))
    return Model(hashed, dense, np.array([r["threshold"] for r in found]))


def broken_pairs(reviews: DataFrame) -> DataFrame:
    """(review_id, defect) of the pairs that are no usable question and answer, one row per defect.

    Of repeated reviews the latest loaded_at counts. A null response is no case, an empty one is; a
    null prompt can't be copied. The classifier is fitted on at most TRAIN_ROWS reviews and on examples of
    phrases alone, which suffice for a small table; how usual words are is counted over all answers.
    """
    spark = reviews.sparkSession
    row = F.struct("loaded_at", "input_json", "raw_response").alias("row")
    latest = reviews.where("id is not null").select("id", row).groupBy("id").agg(F.max("row").alias("row"))
    pairs = stored(latest.select("id", "row.input_json", "row.raw_response").where("raw_response is not null"))
    # Answers in plain prose are held against the corpus's own sentences.
    told = reviews.where("summary is not null").select(F.lit("").alias("source"), F.lit("summary").alias("field"), F.col("summary").alias("text"))
    baselines = text_baselines(told)
    share = word_shares(pairs)
    model = spark.sparkContext.broadcast((fit(spark, pairs, baselines, share), share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_, share_ = model.value
        features = Features(share_)
        for batch in batches:
            ids, prompts, raws, cuts = (batch.column(i).to_pylist() for i in range(4))
            for a in range(0, len(ids), 2_000):
                part = [features.of(p, r, bool(c)) for p, r, c in zip(prompts[a : a + 2_000], raws[a : a + 2_000], cuts[a : a + 2_000])]
                score = model_.scores([g for g, _ in part], np.array([d for _, d in part]))
                found = [(ids[a + i], LABELS[k]) for i, k in zip(*np.nonzero(score > model_.threshold))]
                columns = list(zip(*found)) or [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["review_id", "defect"])

    cut = cut_prose(pairs, baselines)
    return pairs.join(cut, "id", "left").select("id", "input_json", "raw_response", "cut").mapInArrow(run, "review_id string, defect string")
