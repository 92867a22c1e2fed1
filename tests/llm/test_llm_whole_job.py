"""Registration and nested repairs of the training-data operators."""

from __future__ import annotations

import sys

import pytest

import __spark_entry__ as entry_points
from graphloom.llm import encoding_repair


def test_a_failing_import_is_not_swallowed(monkeypatch):
    import graphloom.llm

    monkeypatch.delattr(graphloom.llm, "queries", raising=False)
    monkeypatch.setitem(sys.modules, "graphloom.llm.queries", None)
    with pytest.raises(ImportError):
        entry_points.queries()


@pytest.mark.parametrize("word", ["Привет", "Сообщение"])
def test_another_mistake_below_utf8_is_restored(word):
    garbled = word.encode("koi8-r").decode("cp1251").encode("utf-8").decode("latin-1")
    assert encoding_repair.Repairer().repair(garbled)[:2] == (word, "latin-1>utf-8 cp1251>koi8-r")


CLEAN = [
    "Zażółć gęślą jaźń. Świętość życia jest wartością. Łódź, Gdańsk; źdźbło trawy drży. ŻÓŁĆ ŚWIĘTOŚĆ",
    "Příliš žluťoučký kůň úpěl ďábelské ódy. Nechť již hříšné saxofony rozezvučí síň. ŽLUŤOUČKÝ KŮŇ nový kůn",
    "Árvíztűrő tükörfúrógép. Egy hűtlen vejét fülöncsípő, dühös mexikói úr. Nő, fő, jövő. ÁRVÍZTŰRŐ",
    "Pijamalı hasta yağız şoföre çabucak güvendi. Öğretmen öğrencilere ödev verdi. IĞDIR, ışık, şişe",
    "Việt Nam là một đất nước tươi đẹp. Cảm ơn bạn rất nhiều, hẹn gặp lại. Người dân đường phố. ĐƯỜNG",
    "Știința și tehnologia. Aşa cum ştiţi, vă mulțumesc pentru răspuns. Čovjek želi živjeti, ćevapčići, đak.",
    "Įlinkdama fechtuotojo špaga. Glāžšķūņa rūķīši. Það er gott veður. Jordbær med fløde. Õnn, äär, öö.",
    "Щастя — це коли тебе розуміють. Жълтата дюля беше щастлива. Ξεσκεπάζω την ψυχοφθόρα βδελυγμία.",
    "a²+b²≤c², πr² or 2πr, x≤y; 20°C™ at 10±2mm, 5×3cm, sin²x+cos²x=1, √2≈1.41, ΔT=5K, 10kΩ, 50µg, Windows™, dm³, H₂O, ∫x²dx, (x²−1)",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_of_other_languages_and_formulas_is_left_alone(text):
    assert encoding_repair.Repairer().repair(text) is None


@pytest.mark.parametrize("text", [t for t in CLEAN if "ð" not in t and "²" not in t])
def test_the_same_text_is_restored_from_utf8_read_as_latin(text):
    garbled = text.encode("utf-8").decode("latin-1")
    assert encoding_repair.Repairer().repair(garbled)[0] == text


@pytest.mark.parametrize("layers", [1, 6, 8])
def test_nested_layers_are_undone_to_any_depth(layers):
    text = "Olá, não é"
    for _ in range(layers):
        text = text.encode("utf-8").decode("latin-1")
    assert encoding_repair.Repairer().repair(text)[0] == "Olá, não é"
