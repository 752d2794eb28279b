import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from liveness.llm import pii as P

from .cases import ROWS, clashing, docs, rows


def brute(text):
    """The contract's patterns as they are written."""
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


PIECES = ["a@b.c", "x.y%z@h-1.example.com", "@", "..", "@@", "1.2.3.4", "999.1.1.1", "0001.2.3.4", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111",
          "4111-1111-1111-1112", "+1 (980) 555-6268", "+12", "+1 2345678 ", "é", " ", "word", "\U0001f600", ".", "-", "+", "7"]


@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
@settings(max_examples=400, deadline=None)
def test_plain_identifiers(text):
    assert P.identifiers(text) == brute(text)


def spans(text):
    plain = P.identifiers(text)
    return {(k, text[s:e]) for k, s, e in P.disguised(text, plain, True, True, True)}


@pytest.mark.parametrize("text,kind,source", [
    ("write to john.doe [at] mail [dot] example [dot] com now", "email", "john.doe [at] mail [dot] example [dot] com"),
    ("é john(at)example.com.", "email", "john(at)example.com"),
    ("john dot doe at mail dot example dot org, or", "email", "john dot doe at mail dot example dot org"),
    ("Juan arroba correo punto es aquí", "email", "Juan arroba correo punto es"),
    ("j&#64;example&#46;com", "email", "j&#64;example&#46;com"),
    ("mail jоhn@exаmple.cоm ok", "email", "jоhn@exаmple.cоm"),       # Cyrillic о and а
    ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("jo​hn@exam​ple.com", "email", "jo​hn@exam​ple.com"),
    ("call plus one five five five zero one two three four five six now", "phone", "plus one five five five zero one two three four five six"),
    ("+1 five five five-six two six eight x", "phone", "+1 five five five-six two six eight"),
    ("host one nine two dot one six eight dot zero dot one end", "ip", "one nine two dot one six eight dot zero dot one"),
    ("card four one one one one one one one one one one one one one one one", "card",
     "four one one one one one one one one one one one one one one one"),
    ("card ４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("write to jane.doe at example.com.", "email", "jane.doe at example.com"),
    ("contact jane at mail.example.org, please", "email", "jane at mail.example.org"),
    ("server 192 dot 168 dot 1 dot 1 is up", "ip", "192 dot 168 dot 1 dot 1"),
    ("host 10 dot zero dot 0 dot seven end", "ip", "10 dot zero dot 0 dot seven"),
    ("pay four one one one 1111 1111 1111 with it", "card", "four one one one 1111 1111 1111"),
    ("pay 4111 one one one one, 1111 1111 with it", "card", "4111 one one one one, 1111 1111"),
    ("call +49 three 0 one 234567 now", "phone", "+49 three 0 one 234567"),
])
def test_disguises_map_back_to_source(text, kind, source):
    assert (kind, source) in spans(text)


@pytest.mark.parametrize("text", ["meet me at noon dot", "look at example.com", "one two three", "five at six (at) seven", "plain a@b.c text",
                                  "the dot at the end", "see v at example.com", "it is 3 dot 5 at best",
                                  "pick one 12 or 3", "in 2019 one at 5", "für Größe und Ärger at point", "[dot] (at)"])
def test_nothing_is_added(text):
    assert spans(text) == set()


def test_plain_spans_stay_and_order(spark):
    text = "x [at] y [dot] com, 1.2.3.4, a@b.c, +1 (980) 555-6268"
    r = P.personal_data(docs(spark, [(1, text, "en", "a", 1)])).first()
    assert r.base == "email:29:34,ip:20:27,phone:36:53"
    assert r.spans == "email:0:18,email:29:34,ip:20:27,phone:36:53"


def test_table(spark):
    r = random.Random(4)
    data = [(i, "".join(r.choices(PIECES, k=r.randrange(30))), "en", "a", 1) for i in range(200)] + ROWS
    got = P.personal_data(clashing(docs(spark, data)))
    want = []
    for i, text, *_ in data:
        b = brute(text or "")
        want.append((i, *(sum(k == x for k, _, _ in b) for x in P.KINDS), ",".join(f"{k}:{s}:{e}" for k, s, e in b)))
    assert rows(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base") == sorted(want, key=repr)
    assert P.personal_data(docs(spark, [])).count() == 0


def test_many_addresses_take_linear_time():
    text = "jane.doe@example.com x1 at example.org, " * 50_000
    began = time.time()
    plain = P.identifiers(text)
    assert len(plain) == 50_000 and len(P.disguised(text, plain, True, True, True)) == 50_000
    assert time.time() - began < 20


def test_long_runs_take_linear_time():
    text = "a" * 300_000 + "@" + "1" * 300_000 + " one" * 50_000
    P.disguised(text, P.identifiers(text), True, True, True)
