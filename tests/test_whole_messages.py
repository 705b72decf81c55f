"""The session queries over whole messages, against brute force: bodies hold identifiers beyond their first 200 characters."""

from collections import Counter

from tests.test_rewriting import KEY, mention
from tests.test_whole_texts import brute_spans
from veilworks.operators import conversation as chat
from veilworks.operators.vault import _FIELDS, Vault, rows_of, tables_of
from veilworks.plans import registry

FAR = "zdanie bez danych. " * 30
BODIES = [
    FAR + "PESEL 44051401359, NIP 526-000-12-46 i jan@poczta.pl. " + FAR, "REGON 123456785 i a.b@c.pl " + FAR + "jan@poczta.pl 😀 konto 61 1090 1014 0000 0712 1981 2874",
    FAR * 20 + "dnia 12.01.2024, tel. 601 234 567", "krótko",
]
SESSIONS = {1: BODIES, 2: BODIES[3:], 3: BODIES[:3] * 2}


def test_sessions(spark, tmp_path):
    rows = [(s, t, "user", b) for s, bodies in SESSIONS.items() for t, b in enumerate(bodies)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    ask = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    texts = {(r.session, r.turn): r.text for r in registry._private_chat(spark, str(tmp_path)).collect()}
    assert all(texts[s, t].endswith(". " + b) for s, t, _, b in rows)
    found = [(str(s), kind, x) for (s, _), text in texts.items() for kind, *_, x in brute_spans(text)]
    assert {"PESEL", "NIP", "REGON", "EMAIL_ADDRESS", "DATE_TIME", "PHONE_NUMBER", "POLISH_BANK_ACCOUNT"} <= {k for _, k, _ in found}
    assert {(r.session, r.entity_type): r.n for r in ask("counts_over_history")} == Counter((s, k) for s, k, _ in found)
    total = Counter(s for s, *_ in found)
    assert sorted(map(tuple, ask("pseudonymize_round_trip"))) == [(str(s), len(b), total[str(s)], True, True) for s, b in SESSIONS.items()]
    assert {(r.session, r.entity_type): (r.n, r.one_fake) for r in ask("session_mappings")} == {k: (n, True) for k, n in Counter((s, k) for s, k, _ in set(found)).items()}
    answers = {r.session: r for r in ask("chat_round_trips")}
    assert {s: r.entities for s, r in answers.items()} == total
    assert all(answers[str(s)].answer == texts[s, len(b) - 1] for s, b in SESSIONS.items()) and "601 234 567" not in answers["3"].sent


def test_rows_name_messages(spark):
    """Messages of one session and turn, of no session and of no turn keep their own fakes and come back whole."""
    rows = [("s", 1, "napisz a@poczta.pl"), ("s", 1, "napisz b@poczta.pl"), ("s", 1, "napisz a@poczta.pl"), (None, 1, "napisz c@poczta.pl"), (None, None, "napisz d@poczta.pl"), ("s", None, "napisz e@poczta.pl"), ("t", 2, None)]
    messages = spark.createDataFrame([(s, t, "user", x, "clash") for s, t, x in rows], "session string, turn int, role string, text string, row string")
    hidden, state = chat.pseudonymize(messages, KEY)
    back = chat.depseudonymize(hidden.select("session", "turn", "text", "fake_text"), state, text="fake_text").collect()
    assert hidden.columns[: len(messages.columns)] == messages.columns
    assert sorted(map(repr, [(r.session, r.turn, r.restored) for r in back])) == sorted(map(repr, rows))
    assert all(r.text is None or r.text not in r.fake_text for r in back)
    fakes = {r.text: r.fake_text for r in back if r.session == "s"}
    assert len(fakes) == len(set(fakes.values())) == 3


def test_vault_of_many_people():
    """A word finds only the people who bear it, in order of arrival; loaded tables go on as the kept ones would."""
    names = [f"jan kowal{i}" for i in range(400)]
    one, two = Vault("s"), Vault("s")
    made = [one.get_or_create(mention("PERSON", n, n, n)) for n in names]
    assert len(set(made)) == 400
    held = []
    for i, n in enumerate(names):
        if i == 200:
            held += rows_of("s", two.tables)
            two = Vault("s", tables_of([dict(zip(_FIELDS, r, strict=True)) for r in held]))
        assert two.get_or_create(mention("PERSON", n, n, n)) == made[i]
    assert one.get_or_create(mention("PERSON", "kowal7", "Kowal7", "kowal7")) == made[7].split()[-1]
