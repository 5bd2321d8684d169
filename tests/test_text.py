import pytest
from pyspark.sql import functions as F

from quarry.functions import lexical as L
from quarry.functions import structure as S
from quarry.functions import text as T


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("value", "want"), [(None, ""), ("", ""), ("  a   b​c \n d ", "a bc \n d"), ("é", "é")])
def test_normalize_inline(spark, value, want):
    assert one(spark, T.normalize_inline, value) == want


@pytest.mark.parametrize(("line", "kind"), [
    ("", "empty"), ("......", "ellipsis"), ("NGHỊ ĐỊNH", "document_type"), ("MỤC LỤC", "non_content"), ("Chương II Quy định", "chapter"), ("Mục 1. Chung", "section"),
    ("Điều 5. Phạm vi", "article"), ("Phụ lục I", "appendix"), ("1.2. Nội dung", "numeric"), ("3. Khoản này", "clause"), ("a) điểm", "point"), ("IV. Phần", "roman"),
    ("- gạch", "bullet"), ("Căn cứ Luật", "preamble"), ("Số: 12/2020/NĐ-CP", "metadata"), ("Lời nói đầu", "heading"), ("một câu thường", ""),
])
def test_structural_kind(spark, line, kind):
    assert one(spark, T.structural_kind, line) == kind
    assert S.kind_of(line) == kind


def test_dates_numbers_and_types(spark):
    p = ["NGHỊ ĐỊNH", "Số: 15/2021/NĐ-CP", "Hà Nội, ngày 3 tháng 2 năm 2021", "có hiệu lực kể từ ngày 31/4/2021", "CHÍNH PHỦ"]
    assert one(spark, T.promulgation_date, p, "array<string>") == "2021-02-03"
    assert one(spark, T.effective_date, p, "array<string>") == ""  # no such day
    assert one(spark, T.document_number, p, "array<string>") == "15/2021/NĐ-CP"
    assert one(spark, T.document_type, p, "array<string>") == "NGHỊ ĐỊNH"
    assert one(spark, T.issuing_authority, p, "array<string>") == "Chính phủ"


def test_order_key_puts_numbers_first(spark):
    ids = ["b", "10", "9", "-1", "a"]
    found = spark.createDataFrame([(i,) for i in ids], "x string").orderBy(T.order_key(F.col("x"))).collect()
    assert [r[0] for r in found] == ["9", "10", "-1", "a", "b"]


def test_codes_views_and_domains(spark):
    assert one(spark, T.normalize_code, "15／2021/NĐ–CP.") == "15/2021/nd-cp"
    assert one(spark, T.view_of, "ctx1__p00001") == "packed"
    assert one(spark, T.source_domain, "https://www.Example.org/a?b") == "example.org"
    assert one(spark, T.source_domain, "no url") == ""
    assert one(spark, T.content_body, "[VĂN BẢN] x\n[NỘI DUNG]  y ") == "y"
    assert one(spark, T.years, "năm 1999, 2020 và 12020", "string") == ["1999", "2020"]


def test_html_keeps_what_scripts_hold(spark):
    assert one(spark, T.strip_html, "<p>a&amp;b</p><script>x</script>") == "\na&b\nx"
    assert one(spark, T.strip_html, "1 < 2") == "1 < 2"


def test_tagged_fields(spark):
    f = one(spark, T.tagged_fields, "trước\n[VĂN BẢN] Luật\n[SỐ/KÝ HIỆU] 1/2020\n[NỘI DUNG] a\nb\nb")
    assert (f["title"], f["first_number"], f["body"], f["metadata"]) == ("Luật", "1/2020", "a\nb", "trước")
    assert one(spark, T.tagged_fields, "chỉ chữ")["body"] == "chỉ chữ"


def test_common_prefix(spark):
    assert one(spark, T.common_prefix, [["a", "b", "c"], ["a", "b"], ["a", "b", "d"]], "array<array<string>>") == ["a", "b"]
    assert one(spark, T.common_prefix, [], "array<array<string>>") == []


def test_tokens(spark):
    assert one(spark, L.word_tokens, "Lao_động BHXH, ½") == ["lao_động", "lao", "động", "bhxh", "½"]
    tokens = one(spark, L.query_tokens, "BHXH là gì? Điều 5")
    assert "u¦bảo" in tokens and "r¦dieu_5" in tokens and "b¦là" not in tokens and "a¦bao" in tokens
    assert "g¦là~gì" not in tokens  # both are stop words
    assert one(spark, L.document_tokens, None) == []


def test_paragraphs_and_administration():
    parts, dots = S.paragraphs("Điều 1. Phạm vi\náp dụng cho\n......\nmột câu\ntiếp theo.\nCâu khác")
    assert parts == ["Điều 1. Phạm vi áp dụng cho một câu tiếp theo.", "Câu khác"] and dots == 1
    kept, removed = S.without_administration(["Điều 1. " + "x" * 400, "Nơi nhận: a", "- b", "PHỤ LỤC I", "c"])
    assert kept[1:] == ["PHỤ LỤC I", "c"] and removed == ["Nơi nhận: a", "- b"]
    assert S.without_administration(["một", "Nơi nhận: " + "y" * 90])[1] == []  # a long tail stays


def test_units_pieces_and_packs():
    found = S.units(["Căn cứ Luật", "Chương I", "QUY ĐỊNH CHUNG", "Điều 1. Phạm vi", "1. Khoản một dài", "a) điểm a", "Điều 2. Khác", "nội dung"])
    assert [u.kind for u in found] == ["preamble", "chapter", "article", "clause", "point", "article"]
    assert found[1].title == "QUY ĐỊNH CHUNG" and not found[0].indexable
    assert found[4].hierarchy == ["Chương I", "Điều 1", "Khoản 1", "Điểm a"] and found[5].hierarchy == ["Chương I", "Điều 2"]
    text = " ".join(f"câu {i}." for i in range(400))
    cut = S.pieces(text, 200)
    assert max(map(len, cut)) <= 200 and " ".join(cut) == text
    assert S.pieces(None) == [] and len(S.pieces("x" * 450, 200)) == 3
    assert all(len(b) <= S.BODY for _, b in S.packed(S.units(["Điều 1. A", *["đoạn văn " * 30] * 9])))
