"""Prose of several languages and scripts, and what is no prose."""

import pytest

from orelode.llm import quality as q

PROSE = {
    "en": "We looked at the change this morning and it does what it says. There is one thing that I would like to see before it goes out, and that is a test for the case where the queue is empty.",
    "caps": "THE SCORE FELL BY TEN POINTS SINCE THE ENDPOINTS CAME WITHOUT ANY CHECK OF THEIR INPUT. IT WOULD BE SAFER TO BUILD THE QUERY IN ONE PLACE, AND NOBODY HAS TIME FOR IT NOW.",
    "de": "Wir haben die Änderung heute angesehen, und sie tut, was sie soll. Vor der Freigabe fehlt nur noch ein Test für den Fall, dass die Warteschlange leer ist.",
    "ru": "Сегодня утром мы посмотрели на изменение, и оно делает то, что обещает. Перед выпуском нужен ещё один тест для случая, когда очередь пуста.",
    "fi": "Katsoimme muutosta tänä aamuna ja se tekee mitä lupaa. Ennen julkaisua tarvitaan vielä testi, joka tarkistaa tyhjän jonon käsittelyn.",
    "cs": "Dnes ráno jsme se podívali na změnu a dělá to, co slibuje. Před vydáním ještě chybí test pro případ, kdy je fronta prázdná.",
    "el": "Σήμερα το πρωί εξετάσαμε την αλλαγή και κάνει αυτό που υπόσχεται. Πριν από την έκδοση χρειάζεται ακόμη μία δοκιμή για την άδεια ουρά.",
    "zh": "我们今天早上检查了这个修改，它做到了它所说的事情。发布之前还需要一个测试，用来检查队列为空的情况。",
}
OTHER = {
    "cjk table": "项目\t数量\t价格\n苹果\t三\t五\n香蕉\t二\t六\n梨子\t一\t九", "cjk list": "- 苹果\n- 香蕉\n- 梨子\n- 葡萄", "table": "\n".join(f"{i}\t{i * 37 % 101}\t{i * 7.5}" for i in range(30)),
    "log": "\n".join(f"2024-01-01T00:00:{i:02d} INFO worker-{i} done id={i * 977:x}" for i in range(20)), "list": "\n".join(f"- item_{i}" for i in range(12)), "ruler": "=====\n-----\n=====",
    "words": "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda sigma omega rho tau phi chi psi", "encoded": "QmFzZTY0IGVuY29kZWQgdGV4dCB3aXRob3V0IHdvcmRz" * 8,
}


@pytest.mark.parametrize("name", PROSE)
def test_prose(name):
    assert q.statistics(PROSE[name])[-1]


@pytest.mark.parametrize("name", OTHER)
def test_no_prose(name):
    assert not q.statistics(OTHER[name])[-1]


def test_cases(spark):
    rows = [(1, None, "x"), (2, " \n", "x"), (3, PROSE["en"], "x"), (3, PROSE["en"], "x"), (4, "a " * 200_000, "x"), (5, PROSE["en"] + "\n\n" + OTHER["list"], "x")]
    got = q.text_statistics(spark.createDataFrame(rows, "doc_id bigint, text string, is_prose string")).collect()
    assert sorted((r["doc_id"], r["profile"] == "empty", r["is_prose"]) for r in got) == [(1, True, False), (2, True, False), (3, False, True), (3, False, True), (4, False, False), (5, False, True)]
    assert q.text_statistics(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
