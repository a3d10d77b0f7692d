import random
import unicodedata

import pytest

from strandwise.llm.encodings import forms, normal, utf16_text, with_digits
from strandwise.llm.garbled_text import find_garbled, repair_garbled

SENTENCES = [
    "Le résultat a été gardé grâce à 12 ancres supplémentaires près de la région",
    "L’équipe de garde a déplacé 7 blocs vers la tâche terminée",
    "Für eine Löschung dieser Größe fehlen 148 Belege über die Länge",
    "A decisão será tomada na próxima reunião: ATENÇÃO, OPERAÇÃO SUSPENSA",
    "Файл загружен не полностью, порядке 12 строк",
    "Прочтений без пары найдено 4 в образце",
    "Została porównana z listą następny próg 55 długości",
    "Median span 16 ± 4 bp; tail ≥ 20 bp, °C and µm → “weak” café",
    "この挿入は支持する断片が 12 本しかないため、保留とした。",
    "├── blocks/ │ └── part Æ-tube 14, Ø 18 mm, label Ñ-311",
]
CHAINS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "cp437"), ("utf-8", "mac-roman"), ("utf-8", "iso8859-2"), ("cp1251", "cp1252"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1250", "cp1252"), ("cp850", "cp1252"), ("cp932", "latin-1")]


def garble(text, source, target):
    """As a reader would: bytes that the target lacks are the control characters of that number."""
    out = []
    for byte in text.encode(source):
        try:
            out.append(bytes([byte]).decode(target))
        except UnicodeDecodeError:
            out.append(chr(byte))
    return "".join(out)


def corpus():
    rnd = random.Random(1)
    rows, want = [], {}
    for i in range(len(SENTENCES) * 25):
        text = "\n".join(rnd.sample(SENTENCES, 3)).replace("12", str(rnd.randrange(9, 999)))
        rows.append((i, text))
    i = 10_000
    for source, target in CHAINS:
        for sentence in SENTENCES:
            if rnd.random() < 0.55 and not sentence.isascii():
                try:
                    bad = garble(sentence, source, target)
                except UnicodeEncodeError:
                    continue
                if bad == sentence or (source == "cp932" and "挿入" not in sentence):  # East Asian encodings are tried for East Asian words only
                    continue
                rows.append((i, f"clean words first, {bad}\n{SENTENCES[5]}"))
                want[i] = f"clean words first, {sentence}\n{SENTENCES[5]}"
                i += 1
    twice = garble(garble(SENTENCES[0], "utf-8", "cp1252"), "utf-8", "latin-1")
    rows.append((i, twice))
    want[i] = SENTENCES[0]
    return rows, want


@pytest.fixture(scope="module")
def repaired(spark):
    rows, want = corpus()
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    return rows, want, {r.id for r in find_garbled(df, "id", "text").collect()}, {r.id: r for r in repair_garbled(df, "id", "text").collect()}


def test_finds_exactly_the_garbled_ones(repaired):
    rows, want, found, restored = repaired
    assert found == set(want)
    assert found == set(restored)


def test_restores_the_originals(repaired):
    _, want, _, restored = repaired
    exact = sum(restored[i].restored == text for i, text in want.items())
    assert exact >= 0.95 * len(want), [(restored[i].restored, t) for i, t in want.items() if restored[i].restored != t][:3]
    assert all(r.n_restored > 0 for r in restored.values())


def test_single_sequences_spans_and_lost_characters(spark):
    clean = [(i, s) for i, s in enumerate(SENTENCES * 8)] + [(900 + i, "the reader who checked it came to the same verdict again, błąd") for i in range(8)]
    bad = [(2000, "one bÅ‚ąd".replace("Å‚ą", "łÄ…")), (2001, "F�r eine Länge"), (2002, "rare1�"), (2003, "to " + b"the same verdict again".decode("utf-16-le") + "?"), (2004, "cafÃ©"), (2005, "l?‚quipe"), (2006, "L?‚quipe de garde a d‚plac‚ 7 blocs")]
    df = spark.createDataFrame(clean + bad, "id long, text string")
    got = {r.id: r for r in repair_garbled(df, "id", "text").collect()}
    assert set(got) | {2005} == {i for i, _ in bad}
    assert got[2000].restored == "one błąd" and got[2001].restored == "Für eine Länge" and got[2004].restored == "café"
    assert got[2003].restored == "to the same verdict again?"
    assert (got[2002].n_restored, got[2002].n_left, got[2002].restored) == (0, 1, "rare1�")
    assert got[2006].restored == "L’équipe de garde a déplacé 7 blocs"


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "id long, text string")
    assert find_garbled(none, "id", "text").count() == repair_garbled(none, "id", "text").count() == 0
    plain = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "plain? text"), (5, "x" * 300_000 + "é " * 100_000), (None, "é"), (6, "Ã")], "id long, text string")
    assert find_garbled(plain.withColumnRenamed("id", "word"), "word", "text").count() == 0


def test_forms():
    assert forms("café", False)["cafÃ©"] == ("utf-8>cp1252", "wide")
    assert forms("café", False)["caf�"][1] == "lossy" and forms("café", False)["cafй"][1] == "same"
    assert "dÃ©jÃ" in forms("déjà", False)
    # beside a soft space that a form has may stand a clean rest of the word
    assert "coöperation" not in forms("x愠coöperation", False) and "öl" not in forms("àöl", False)
    assert "L’Ã©quipe" in forms("L’équipe", False) and "LÃ¢â‚¬â„¢ÃƒÂ©quipe" in forms("L’équipe", False)
    assert utf16_text("[07:39] INFO block 22".encode().decode("utf-16-le", "ignore")) and utf16_text("ここにはとく") is None
    assert normal("RG053é12") == "RG0é0" and with_digits("RG0e0", "RG053é12") == "RG053e12" and with_digits("RG0", "RG5é1") is None
    assert utf16_text("ab cd ef".encode().decode("utf-16-le")) == "ab cd ef" and utf16_text("日本") is None
    assert unicodedata.normalize("NFC", "é") in forms("é", True) or forms("é", True)


def test_copies_and_words_that_numbers_leave_open(spark):
    """A garbled text of which a third of the rows are copies, and one whose clean words stand in a single other text."""
    bad = garble("Файл загружен не полностью, порядке 12 строк", "cp1251", "koi8-r")
    clean = [f"Файл загружен не полностью, порядке 12 строк: {chr(97 + i)}" for i in range(9)] + [f"garde près résultat numéro {chr(97 + i)}" for i in range(11)]
    rare = "Прочтений образце найдено пары без"
    rows = [*clean, *[bad] * 10, f"{rare} résultat numéro", garble(rare, "cp1251", "koi8-r")]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    want = {i: "Файл загружен не полностью, порядке 12 строк" for i in range(20, 30)} | {31: rare}
    got = {r.id: r.restored for r in repair_garbled(df, "id", "text").collect()}
    assert got == want
    assert {r.id for r in find_garbled(df, "id", "text").collect()} == set(want)
