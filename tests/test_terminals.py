"""Tokens against terminals, every expectation written by hand."""

import pytest
from pyspark.sql import functions as F

from treeloom.functions import features as X
from treeloom.operators import terminals as M

TABLES = dict(
    prepositions={"til": ["ef"], "um": ["þf", "nh"], "samkvæmt": ["þgf"]},
    common=["um"],
    frames={"gefa": ["_þgf_þf", "_þf"], "vanta": ["_þf"], "eignast": ["_þf"]},
    subjects={"langa": ["þf"], "vanta": ["þf", "lhþt"], "rigna": ["none"]},
    impersonal=["langa"],
    arguments={"samþykkur": ["þgf"]},
    not_names=["dómur"],
    only_adverbs=["víða"],
)


def word(txt, cat=None, infl="", lemma=None, form=None, cls="alm"):
    return ("WORD", txt, None, None, None, None, None), None if cat is None else (cat, cls, lemma or txt.lower(), form or txt.lower(), infl)


def other(kind, txt, value=None, iso=None, cases=None, genders=None, names=None):
    return (kind, txt, value, iso, cases, genders, names), None


CASES = [
    # nouns
    (word("hestur", "kk", "NFET"), "no_nf_et_kk", True),
    (word("hestur", "kk", "NFET"), "no_nf_et_kvk", False),
    (word("hestur", "kk", "NFET"), "no_þf_et", False),
    (word("hesturinn", "kk", "NFETgr", "hestur"), "no_nf_gr", True),
    (word("hestur", "kk", "NFET"), "no_nf_gr", False),
    (word("læknir", "kk", "NFET"), "no_xir", True),
    (word("hestur", "kk", "NFET"), "no_xir", False),
    (word("karlana", "kk", "ÞFFTgr", "karl"), "no_zana", True),
    (word("kg", "hk", "-"), "no_þgf_ft", True),
    (word("kg", "hk", "-"), "no_þgf_gr", False),
    (word("kg", "hk", "-"), "no_abbrev", True),
    (word("Anna", "kvk", "NFET", cls="nafn"), "no_nf", False),
    # persons, places, proper names
    (word("Anna", "kvk", "NFET", cls="nafn"), "person_nf_kvk", True),
    (word("Anna", "kvk", "NFET", cls="nafn"), "person_þf_kvk", False),
    (word("Anna", "kvk", "NFET", cls="nafn"), "person_nf_kk", False),
    (word("Thorsteinsson", "kk", "-", cls="ætt"), "person_ef_kvk", True),
    (word("Laugavegur", "kk", "NFET", cls="göt"), "gata_nf_kk", True),
    (word("Laugavegur", "kk", "NFET", cls="göt"), "gata_þf", False),
    (word("Samsett", "hk", "NFET", "sam-sett"), "sérnafn", True),
    (word("Heimur", "kk", "NFET"), "sérnafn", False),
    (word("Heimur", "kk", "NFET"), "sérnafn_nf", True),
    (word("Dómur", "kk", "NFET"), "sérnafn_nf", False),
    # adjectives and pronouns
    (word("góðan", "lo", "FSB-KK-ÞFET", "góður"), "lo_þf_kk_et", True),
    (word("góðan", "lo", "FSB-KK-ÞFET", "góður"), "lo_nf_kk", False),
    (word("samþykkur", "lo", "FSB-KK-NFET"), "lo_sþgf_nf", True),
    (word("samþykkur", "lo", "FSB-KK-NFET"), "lo_sef_nf", False),
    (word("hæstv.", "lo", "-"), "lo_ef_ft", True),
    (word("sig", "abfn", "ÞFET"), "abfn_þf_kk_ft", True),
    (word("mig", "pfn", "ÞFET"), "pfn_þf_et_kvk", True),
    (word("mig", "pfn", "ÞFET"), "pfn_þf_ft", False),
    # small words
    (word("sem", "st", "-"), "stt", True),
    (word("og", "st", "-"), "stt", False),
    (word("um", "ao", "-"), "eo", False),
    (word("víða", "ao", "-"), "eo", True),
    (word("oftar", "ao", "MST"), "ao_mst", True),
    (word("oftar", "ao", "MST"), "ao_est", False),
    (word("til", "ao", "-"), "fs_ef", True),
    (word("til", "fs", "-"), "fs_þf", False),
    (word("um", "ao", "-"), "fs_þf", False),
    (word("um", "fs", "-"), "fs_þf", True),
    (word("skv.", "fs", "-", "samkvæmt"), "fs_þgf", True),
    (word("fimm", "töl", "-"), "töl_þf", True),
    # verbs
    (word("gefur", "so", "GM-FH-NT-3P-ET", "gefa"), "so_2_þgf_þf_p3_et", True),
    (word("gefur", "so", "GM-FH-NT-3P-ET", "gefa"), "so_2_þf_þgf", False),
    (word("gefur", "so", "GM-FH-NT-3P-ET", "gefa"), "so_0", False),
    (word("gefur", "so", "GM-FH-NT-3P-ET", "gefa"), "so_p1", False),
    (word("gefur", "so", "GM-FH-NT-3P-ET", "gefa"), "so_ft", False),
    (word("veipar", "so", "GM-FH-NT-3P-ET", "veipa"), "so_0_et", True),
    (word("veipar", "so", "GM-FH-NT-3P-ET", "veipa"), "so_1_þf", False),
    (word("eignaðist", "so", "MM-FH-ÞT-3P-ET", "eigna"), "so_1_þf_mm", True),
    (word("gefið", "so", "GM-SAGNB", "gefa"), "so_1_þf", False),
    (word("gefið", "so", "GM-SAGNB", "gefa"), "so_1_þf_sagnb", True),
    (word("langar", "so", "GM-FH-NT-3P-ET", "langa"), "so_et", False),
    (word("langar", "so", "GM-FH-NT-3P-ET", "langa"), "so_subj_þf", True),
    (word("langar", "so", "GM-FH-NT-3P-ET", "langa"), "so_subj_þgf", False),
    (word("vantar", "so", "OP-GM-FH-NT-3P-ET", "vanta"), "so_1_þf_subj_op_þf", True),
    (word("rignir", "so", "GM-FH-NT-3P-ET", "rigna"), "so_subj_none", True),
    (word("dags.", "so", "-", "dagsetja"), "so_1_þf_p3", True),
    # literals and unknown words
    (word("hestur", "kk", "NFET"), "'hestur'_nf", True),
    (word("hestur", "kk", "NFET"), "'hestur'_þf", False),
    (word("hafast", "so", "MM-NH", "hafa"), "'hafa:so'", False),
    (word("hafast", "so", "MM-NH", "hafa"), "'hafa:so'_mm", True),
    (word("Hér", "ao", "-", "hér"), '"hér"', True),
    (word("Blorg"), "sérnafn", True),
    (word("blorg"), "no_et_hk_þgf", True),
    (word("blorg"), "no_et_kk", False),
    # other kinds
    (other("NUMBER", "21", 21.0, cases=["nf"], genders=["kk"]), "tala_et", True),
    (other("NUMBER", "11", 11.0), "tala_et", False),
    (other("NUMBER", "1066", 1066.0), "ártal", True),
    (other("NUMBER", "3000", 3000.0), "ártal", False),
    (other("NUMBER", "2", 2.0), "töl", False),
    (other("NUMBER", "2", 2.0, cases=["þf"], genders=["kk"]), "to_þf_kk_ft", True),
    (other("NUMBER", "2", 2.0, cases=["þf"], genders=["kk"]), "to_þf_kvk", False),
    (other("NUMBER", "2", 2.0, cases=["þf"]), "to_þf", False),
    (other("YEAR", "1999", 1999.0), "ártal_et", True),
    (other("YEAR", "1999", 1999.0), "töl_ft", False),
    (other("PERCENT", "5 %", 5.0, cases=["þf"]), "no_hk_þf", True),
    (other("PERCENT", "5 %", 5.0, cases=["þf"]), "no_kk", False),
    (other("CURRENCY", "króna", iso="ISK", cases=["nf"], genders=["kvk"]), "currency_isk_nf", True),
    (other("CURRENCY", "króna", iso="ISK", cases=["nf"], genders=["kvk"]), "currency_usd", False),
    (other("CURRENCY", "króna", iso="ISK", cases=["nf"], genders=["kvk"]), "no_kk_nf", False),
    (other("AMOUNT", "21 króna", 21.0, "ISK", ["nf"], ["kvk"]), "no_et_kvk_nf", True),
    (other("AMOUNT", "2 krónur", 2.0, "ISK", ["nf"], ["kvk"]), "no_et_kvk_nf", False),
    (other("AMOUNT", "2 krónur", 2.0, "ISK"), "amount", True),
    (other("PERSON", "Anna Berg", names=[("Anna Berg", "kvk", "nf")]), "person_nf_kvk", True),
    (other("PERSON", "Anna Berg", names=[("Anna Berg", "kvk", "nf")]), "person_nf_kk", False),
    (other("PERSON", "Anna", names=[("Anna", "kvk", "nf")]), "sérnafn_nf", True),
    (other("PERSON", "Anna Berg", names=[("Anna Berg", "kvk", "nf")]), "sérnafn_nf", False),
    (other("PUNCTUATION", ","), "','", True),
    (other("EMAIL", "a@b.is"), "tölvupóstfang", True),
    (other("EMAIL", "a@b.is"), "vefslóð", False),
    (other("DATEABS", "1. maí 1999"), "dagsföst", True),
    (other("TIMESTAMPREL", "kl. 5 á morgun"), "tímapunkturafs", True),
    (other("ORDINAL", "3."), "raðnr_kk", True),
    (word("iv"), "sequence_roman", True),
    (word("iiii"), "sequence_roman", False),
    (word("ab"), "sequence_letters", True),
    (other("NUMBER", "12", 12.0), "sequence_digits", True),
]


def test_terminals_by_hand(spark):
    rows = [(i, token, reading, terminal) for i, ((token, reading), terminal, _) in enumerate(CASES)]
    table = spark.createDataFrame(rows, f"id int, token {M.TOKEN}, reading {M.READING}, terminal string")
    got = {r.id: r.ok for r in table.select("id", M.matches(F.col("token"), F.col("reading"), F.col("terminal"), M.Tables(**TABLES)).alias("ok")).collect()}
    wrong = [(CASES[i][0][0][1], CASES[i][1], got[i]) for i in got if got[i] != CASES[i][2]]
    assert not wrong and len(got) == len(CASES)


def test_match_join_takes_the_first_reading(spark):
    tokens = [(1, word("við")[0], [("pfn", "alm", "ég", "við", "NFFT"), ("fs", "alm", "við", "við", "-")]), (2, word("blorg")[0], [])]
    table = spark.createDataFrame(tokens, f"id int, token {M.TOKEN}, readings array<{M.READING}>")
    names = spark.createDataFrame([("pfn_nf_ft",), ("pfn_nf",), ("no_et_hk",), ("fs",)], "terminal string")
    got = {(r.id, r.terminal, r.reading and r.reading.cat) for r in M.match_join(table, names, M.Tables(**TABLES)).collect()}
    assert got == {(1, "pfn_nf_ft", "pfn"), (1, "pfn_nf", "pfn"), (2, "no_et_hk", None)}


@pytest.mark.parametrize(
    "infl, names",
    [
        ("GM-FH-NT-1P-ET", {"gm", "fh", "nt", "p1", "et"}),
        ("NFETgr", {"nf", "et", "gr"}),
        ("LHÞT-SB-KK-NFET", {"lhþt", "sb", "kk", "nf", "et"}),
        ("ESB-KK-NFET", {"esb", "kk", "nf", "et"}),
        ("OP-GM-FH-ÞT-3P-ET", {"op", "gm", "fh", "þt", "et"}),
        ("LH-NT", {"lh", "nt"}),
    ],
)
def test_variants_of_real_strings(spark, infl, names):
    row = spark.range(1).select(X.variants_of(F.lit(infl)).alias("v"), X.mask_of(F.lit(infl)).alias("m")).first()
    assert set(row.v) == names
    assert all(row.m & X.bit(v) for v in names) and not row.m & (X.bit("0") | X.bit("1") | X.bit("2"))
