"""Word lists and patterns of a language. They are ours, chosen for the rules here; a pack can be replaced by another."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LanguagePack:
    #: Words that may stand twice in a row.
    repeatable: tuple[str, ...] = ("çok", "az", "yavaş", "tek", "ayrı", "sık", "zaman", "bir", "nous", "vous", "sich", "that", "had", "der", "die")
    #: Words that leave a sentence open at its end.
    connectors: tuple[str, ...] = ("ve", "veya", "ile", "ama", "fakat", "ancak", "çünkü", "and", "or", "but", "et", "ou", "und", "oder", "y", "o")
    #: Compounds that are written as two words, by their closed spelling.
    compounds: tuple[tuple[str, str], ...] = (("herşey", "her şey"), ("hiçbirşey", "hiçbir şey"), ("pekçok", "pek çok"), ("birşey", "bir şey"), ("herhangibir", "herhangi bir"), ("yada", "ya da"), ("birtakım", "bir takım"))
    months: tuple[str, ...] = ("ocak", "şubat", "mart", "nisan", "mayıs", "haziran", "temmuz", "ağustos", "eylül", "ekim", "kasım", "aralık")
    currencies: tuple[str, ...] = ("TL", "TRY", "₺", "Türk Lirası")
    abbreviations: tuple[str, ...] = ("av", "dr", "prof", "md", "no", "sok", "cad", "bkz", "vb", "vs", "örn", "st", "mr", "mme", "bzw")
    #: Corrections of a user: misspelling and replacement.
    corrections: tuple[tuple[str, str], ...] = (("karari", "kararı"), ("muvekkil", "müvekkil"))
    accepted: tuple[str, ...] = ("hiçbirşey",)


TURKISH = LanguagePack()
