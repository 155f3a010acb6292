"""Stop words and stems, with the examples of the paper."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions.tokenize import prepared, tokens

EXAMPLES = """
caresses caress  ponies poni  ties ti  caress caress  cats cat  feed feed  agreed agre  plastered plaster  bled bled  motoring motor  sing sing
conflated conflat  troubled troubl  sized size  hopping hop  tanned tan  falling fall  hissing hiss  fizzed fizz  failing fail  filing file
happy happi  sky sky  relational relat  conditional condit  rational ration  digitizer digit  conformabli conform  radicalli radic  differentli differ
vileli vile  analogousli analog  vietnamization vietnam  predication predic  operator oper  feudalism feudal  decisiveness decis  hopefulness hope
callousness callous  formaliti formal  sensitiviti sensit  sensibiliti sensibl  triplicate triplic  formative form  formalize formal  electriciti electr
electrical electr  hopeful hope  goodness good  revival reviv  allowance allow  inference infer  airliner airlin  gyroscopic gyroscop  adjustable adjust
defensible defens  irritant irrit  replacement replac  adjustment adjust  dependent depend  adoption adopt  homologou homolog  communism commun
activate activ  angulariti angular  homologous homolog  effective effect  bowdlerize bowdler  probate probat  rate rate  cease ceas  controll control
roll roll  articles articl  operation oper  computers comput  generalizations gener  oscillators oscil  enjoy enjoi  syzygy syzygi
as as  by by  is is  x-rays x-rays  b52s b52s  café café  ^yes ^yes
"""


def test_stems(spark):
    pairs = [tuple(EXAMPLES.split()[k : k + 2]) for k in range(0, len(EXAMPLES.split()), 2)]
    df = spark.createDataFrame([([a for a, _ in pairs],), ([],), (None,)], "terms array<string>")
    found = [r[0] for r in df.select(prepared(F.col("terms"), stem=True)).collect()]
    assert list(zip((a for a, _ in pairs), found[0], strict=True)) == pairs
    assert found[1:] == [[], None]


def test_stop_list(spark):
    df = spark.createDataFrame([("The operations of THE computers, of course",), (None,)], "text string")
    terms = tokens(F.col("text"))
    rows = df.select(prepared(terms, ["the", "of"]).alias("a"), prepared(terms, ["the", "of"], True).alias("b"), prepared(terms).alias("c")).collect()
    assert rows[0].a == ["operations", "computers", "course"] and rows[0].b == ["oper", "comput", "cours"]
    assert rows[0].c == ["the", "operations", "of", "the", "computers", "of", "course"] and rows[1].b == []
