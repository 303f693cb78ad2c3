"""Row-wise functions over the corpus's blocks, tokens or small fixtures; one statement each."""

from __future__ import annotations

from collections.abc import Callable

from vellumgrid.functions import text as f
from vellumgrid.plans.dialect import Dialect, Statement
from vellumgrid.sources import fixtures

Expression = Callable[[Dialect], str]


def over_blocks(**columns: Expression):
    return lambda d: Statement("SELECT doc_id, block_index, " + ", ".join(f"{e(d)} AS {n}" for n, e in columns.items()) + " FROM blocks")


def over_fixture(rows: list, of: str, **columns: Expression):
    return lambda d: Statement("SELECT id, x, " + ", ".join(f"{e(d)} AS {n}" for n, e in columns.items()) + " FROM fixture", (d.values("fixture", f"id BIGINT, x {of}", list(enumerate(rows))),))


def strings(**columns: Expression):
    return over_fixture(fixtures.TOKENS, "string", **columns)


NUMBERS = [0, 1, 4, 9, 14, 26, 29, 40, 90, 399, 999, 1000, 1024, 1994, 3999, 4000, 10240, 1048576, 5300000, 123456789]
B = "text"
pt = lambda factor: lambda d: f"CAST(round(x * {factor}) AS BIGINT)"

SCALARS = {
    "s01_format_from_name": over_fixture(fixtures.NAMES, "string", format=lambda d: f"(CASE {f.extension(d, 'x')} WHEN 'docx' THEN 'docx' WHEN 'udf' THEN 'udf' ELSE 'none' END)"),
    "s14_container_sniff": over_fixture(fixtures.CONTENTS, "string", container=lambda d: f.sniff(d, "x")),
    "s16_source_kind": over_fixture(fixtures.NAMES, "string", kind=lambda d: f"(CASE WHEN {f.extension(d, 'x')} IN ('docx', 'doc', 'udf', 'pdf', 'txt', 'xlsx', 'pptx') THEN {f.extension(d, 'x')} WHEN {f.extension(d, 'x')} IN ('jpg', 'jpeg', 'png', 'tif', 'tiff', 'heic') THEN 'image' ELSE 'unknown' END)"),
    "p01_tr_lower": over_blocks(value=lambda d: f.tr_lower(d, B)),
    "p02_tr_upper": strings(value=lambda d: f.tr_upper(d, "translate(x, 'ß', 's')")),
    "p03_word_chars": over_blocks(value=lambda d: d.count(B, f.WORD)),
    "p04_vowels": over_blocks(value=lambda d: d.count(B, "[aeıioöuüAEIİOÖUÜ]")),
    "p05_normalize": over_blocks(value=lambda d: f.normalized(d, B)),
    "p06_canonical": over_blocks(value=lambda d: f.canonical(d, B)),
    "p07_tokens": over_blocks(n=lambda d: d.size(f.tokens(d, B)), joined=lambda d: d.join(f.tokens(d, B), "|")),
    "p12_excerpt": over_blocks(value=lambda d: f"substring({B}, greatest(1, 11), 40)"),
    "p13_context_snippet": over_blocks(value=lambda d: d.replace(f"translate(substring({B}, 1, 68), '​­﻿', '···')", r"[ \t\r\n]+", " ")),
    "p14_char_offsets": over_blocks(chars=lambda d: f"CAST(length({B}) AS BIGINT)", piece=lambda d: f"substring({B}, 6, 5)"),
    "p15_body_text": over_blocks(value=lambda d: d.replace(B, r"^ *([0-9]{1,3}|\p{L})[.)] +")),
    "p17_base_name": strings(value=lambda d: f.base_name(d, "x")),
    "p18_ascii_fold": over_blocks(value=lambda d: f.ascii_fold(d, B)),
    "p19_turkish_letters": over_blocks(value=lambda d: d.count(B, "[çğıöşüÇĞİÖŞÜ]")),
    "p20_diacritic_fix_applies": strings(value=lambda d: f"({f.ascii_fold(d, 'x')} = {f.tr_lower(d, 'x')} AND x <> '')"),
    "p21_collapse_spaces": over_blocks(value=lambda d: d.replace(B, "[ \t]+", " ")),
    "p22_carry_case": strings(value=lambda d: f.carry_case(d, "x", "'ışık'")),
    "p23_address_guard": over_blocks(value=lambda d: d.like(B, r"(www[.]|https?://|[\p{L}\p{N}]+@[\p{L}\p{N}]+[.]|[\p{L}\p{N}]+[.][\p{L}\p{N}]+[.][\p{L}])")),
    "p24_dot_roles": over_blocks(
        number=lambda d: d.count(B, r"[0-9][.][0-9]"), initialism=lambda d: d.count(B, r"(\p{Lu}[.]){2,}"), ellipsis=lambda d: d.count(B, r"[.]{3}"), sentence_end=lambda d: d.count(B, r"[\p{Ll}\p{N})”\"][.]( |$)"),
    ),
    "p25_output_name": over_fixture(fixtures.NAMES, "string", value=lambda d: f"concat({f.stem(d, 'x')}, '-corrected', {d.extract('x', '([.][^.]*)$', 1)})"),
    "p26_safe_file_name": strings(value=lambda d: f.safe_name(d, "x")),
    "p27_technical_noise": over_blocks(value=lambda d: f"trim({d.replace(d.replace(d.replace(B, '[­​﻿]'), '([.]{4,}|_{3,}|…{2,})', '____'), '[ \t]+', ' ')})"),
    "p28_loose_form": over_blocks(value=lambda d: f"trim({d.replace(f.normalized(d, B), r'[^\p{L}\p{N}]+', ' ')})"),
    "p29_compare_tokens": over_blocks(n=lambda d: d.size(d.extract_all(B, r"[\p{L}\p{N}._-]+@[\p{L}\p{N}.-]+|[0-9]+([.,][0-9]+)*|[\p{L}\p{N}]+(['’][\p{L}]+)?|[^ \t\r\n]"))),
    "p30_structural_prefix": over_blocks(article=lambda d: d.extract(B, r"^ *((Madde|MADDE|Article) [0-9]+)", 1), clause=lambda d: d.extract(B, r"^ *([0-9]{1,3}([.][0-9]{1,3})+)[.)]? ", 1), numbered=lambda d: d.extract(B, r"^ *([0-9]{1,3})[.)] ", 1)),
    "p31_appendix_heading": over_blocks(number=lambda d: d.extract(f.tr_upper(d, B), r"^ *EK[ -]*([0-9]{1,3})([^0-9\p{L}]|$)", 1)),
    "p32_classify_block": over_blocks(kind=lambda d: f"(CASE WHEN trim({B}) = '' THEN 'blank' WHEN {d.like(B, r'^ *([0-9]{1,3}|\p{L})[.)] ')} THEN 'list_item' WHEN {d.like(B, ' [|] ')} THEN 'table_row' WHEN length({B}) <= 80 AND {B} = upper({B}) AND {d.like(B, r'\p{L}')} THEN 'heading' ELSE 'paragraph' END)"),
    "p33_escapes": over_blocks(xml=lambda d: f.escape_xml(d, B), markdown=lambda d: f.escape_markdown(d, B)),
    "p34_human_size": over_fixture(NUMBERS, "BIGINT", tenths=lambda d: "CAST(CASE WHEN x < 1024 THEN x * 10 WHEN x < 1048576 THEN floor((x * 10 + 512) / 1024) ELSE floor((x * 10 + 524288) / 1048576) END AS BIGINT)", unit=lambda d: "(CASE WHEN x < 1024 THEN 'B' WHEN x < 1048576 THEN 'KB' ELSE 'MB' END)"),
    "p35_redact": strings(value=lambda d: f.redacted(d, "x")),
    "p36_relative_time": over_fixture([0, 59, 60, 3599, 3600, 86399, 86400, 604800, 2592000], "BIGINT", value=lambda d: f"(CASE WHEN x < 60 THEN 'now' WHEN x < 3600 THEN concat(CAST(CAST(floor(x / 60) AS BIGINT) AS {d.kind('string')}), ' min') WHEN x < 86400 THEN concat(CAST(CAST(floor(x / 3600) AS BIGINT) AS {d.kind('string')}), ' h') ELSE concat(CAST(CAST(floor(x / 86400) AS BIGINT) AS {d.kind('string')}), ' d') END)"),
    "p37_amount_text": over_fixture(NUMBERS, "BIGINT", value=lambda d: f.digits_grouped(d, "x")),
    "p38_units": over_fixture(NUMBERS, "BIGINT", twips=pt(20), half_points=pt(2), emu=pt(12700), red=lambda d: "CAST(floor(x / 65536) AS BIGINT) % 256", green=lambda d: "CAST(floor(x / 256) AS BIGINT) % 256", blue=lambda d: "x % 256"),
    "p39_image_kind": over_fixture(fixtures.CONTENTS, "string", value=lambda d: f"(CASE WHEN {f.sniff(d, 'x')} IN ('jpeg', 'png', 'tiff', 'heic') THEN {f.sniff(d, 'x')} ELSE 'none' END)"),
    "p40_paper_size": over_fixture(list(range(590, 600)) + [612, 842, 419], "BIGINT", value=lambda d: "(CASE WHEN abs(x - 595.28) < 3 THEN 'A4' WHEN abs(x - 612) < 3 THEN 'Letter' WHEN abs(x - 419.53) < 3 THEN 'A5' WHEN abs(x - 841.89) < 3 THEN 'A3' ELSE 'custom' END)"),
    "p41_text_width": over_blocks(tenths=lambda d: f"5 * CAST(length({B}) AS BIGINT) + 2 * {d.count(B, '[mwMW]')} - 3 * {d.count(B, '[iıljtf.,;:!]')}"),
    "p42_content_digest": over_blocks(value=lambda d: d.sha256(B)),
    "m01_letter_values": over_fixture(list("AaBÇçĞıİizZwQ1") + ["AB", ""], "string", latin=lambda d: f.letter_value(d, "x", "latin"), turkish=lambda d: f.letter_value(d, "x", "turkish")),
    "m01_value_letters": over_fixture([*range(0, 31)], "BIGINT", latin=lambda d: f.value_letter(d, "x", "latin"), turkish=lambda d: f.value_letter(d, "x", "turkish")),
    "m02_roman_values": over_fixture(["I", "iv", "IX", "xıv", "XL", "XC", "CD", "CM", "MCMXCIV", "IIII", "VX", "ABC", "", "MMMCMXCIX"], "string", value=lambda d: f.roman_value(d, "x")),
    "m02_roman_numerals": over_fixture(NUMBERS, "BIGINT", value=lambda d: f.roman_numeral(d, "x")),
    "m04_amounts": over_fixture(["1.250,50", "300", "12,5", "1.25", "1.250.000,00", "12,345", "", "a", "0,05"], "string", hundredths=lambda d: f.amount(d, "x")),
    "m09_counter_formats": over_fixture(list(range(1, 27)), "BIGINT", decimal=lambda d: f"CAST(x AS {d.kind('string')})", roman=lambda d: f"lower({f.roman_numeral(d, 'x')})", letter=lambda d: f"lower({f.value_letter(d, 'x', 'latin')})"),
    "m10_half_up": over_fixture(NUMBERS, "BIGINT", percent=lambda d: "CAST(floor((x * 1000 / 4096 + 5) / 10) AS BIGINT)"),
    "m12_file_stamp": over_fixture([0, 86399, 951782400, 1709164800, 1735689599], "BIGINT", day=lambda d: "CAST(floor(x / 86400) AS BIGINT)", clock=lambda d: "lpad(CAST(CAST(floor(x % 86400 / 3600) AS BIGINT) AS " + d.kind("string") + "), 2, '0')"),
    "f02_eligible_blocks": over_blocks(words=lambda d: f.words(d, B), eligible=lambda d: f"({f.words(d, B)} >= 6)", near=lambda d: f"({f.words(d, B)} >= 12)"),
    "f05_heading_blocks": over_blocks(value=lambda d: f"({f.words(d, B)} BETWEEN 1 AND 12 AND NOT {d.like(B, '[.;,] *$')} AND {d.like(B, r'\p{L}')} AND {B} = {f.tr_upper(d, B)})"),
    "f06_label_blocks": over_blocks(value=lambda d: f"(length(trim({B})) BETWEEN 1 AND 48 AND {f.words(d, B)} <= 6 AND NOT {d.like(B, '[.,;:!?]')} AND {d.like(B, r'\p{L}')} AND {B} = {f.tr_upper(d, B)})"),
    "f07_slot_shape": over_blocks(value=lambda d: d.count(B, r"\[[\p{Lu} /]{2,40}\]")),
    "f08_suffix_shape": over_blocks(value=lambda d: d.count(B, r"['’]\p{Ll}{1,4}([^\p{L}]|$)")),
    "f09_inline_enumerators": over_blocks(value=lambda d: d.count(B, r"(^| )[\p{L}0-9]{1,2}[)] ")),
    "f11_meaningful_saving": over_fixture([1, 10, 20, 25, 30, 31, 100, 400, 500, 600], "BIGINT", value=lambda d: "(x * 100 >= 3 * 1000 OR (x * 100 >= 2 * 1000 AND x >= 100) OR x >= 500)"),
    "f12_blank_pages": over_fixture([0, 1, 14, 15, 16, 200], "BIGINT", blank=lambda d: "(x <= 15)"),
    "s09_decode_text": over_fixture(["efbbbf4142", "c3a7", "41"], "string", bom=lambda d: "(substring(x, 1, 6) = 'efbbbf')", body=lambda d: "(CASE WHEN substring(x, 1, 6) = 'efbbbf' THEN substring(x, 7) ELSE x END)"),
    "g07_terminators": over_blocks(value=lambda d: d.replace(B, "[ \t\r\n]+$")),
    "g15_printable": over_blocks(value=lambda d: d.like(B, r"^[ -~¡-ÿ\p{L}’“”–—…]*$")),
}
