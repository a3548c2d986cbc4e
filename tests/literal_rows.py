"""Literal manuscripts, sections, messages and files that the queries without a test table run over."""

from __future__ import annotations

import io
import zipfile

MANUSCRIPTS = [
    (
        "01-가",
        "가.",
        "목표와 전략",
        "[장: 1]\n# 비전과 목표\n\n○ 함께 사는 복지 도시[^1]\n  - 이용자 1,200 명, 만족도 87.5%\n▪ 세부사업 3개\n※ 자료: 내부\n{cols=1,2}\n| 전략 | 과제 |\n|---|---|\n| 돌봄 사업 | 확충 |\n\n| 자립 지원 | 연계 | 남음 |\n본문이 이어진다\n[^1]: 조례\n",
    ),
    ("01-나", "나.", "추진 체계", "## 추진전략\n#### 너무 깊은 제목\n○ 첫째 [^2]\n그다음 줄\n| a | b |\n| 1 |\n끝\n[표: 잃은 제목]\n- 문장. [^3]\n[^3]: 셋\n[^4]: 넷\n"),
    ("02-가", "가.", "재정", "# 예산\n\n[표: 연도별]\n\n{cols=3,1}\n\n| 연도 | 억원 |\n|:--|--:|\n| 2024 | 10 |\n※ 단위: 억원\n\n![그림](chart.png)\n\n- 30억원과 30 억원\n"),
    ("02-나", "나.", "빈 원고", ""),
]

NODES = [
    # id, parent, title, ord, has (instructions), children, forms
    ("01", None, "목표", 0, False, 2, 0), ("01-가", "01", "[사회보장 전략 1_돌봄]", 1, False, 1, 2), ("01-가-1", "01-가", "세부", 2, True, 0, 1),
    ("01-나", "01", "[사회보장 전략 2_자립]", 3, False, 0, 0), ("02", None, "재정", 4, True, 1, 0), ("02-가", "02", "목표", 5, False, 0, 1),
    ("03", None, "점검", 6, False, 0, 0), ("04-가", "04", "고아", 7, False, 0, 0), ("05", "06", "고리", 8, False, 1, 0), ("06", "05", "고리", 9, False, 1, 0),
]

TABLES = [
    # section, seq, rows, cols, grid, whether the text before opens examples
    ("01", 1, 2, 1, [["◆ 작성 취지 및 방법 ◆\n작성 취지: 왜\n작성 방법: 어떻게"], [""]], False), ("01", 2, 2, 2, [["이름", "값"], ["", ""]], False), ("01", 3, 2, 2, [["이름", "값"], ["a", "b"]], False),
    ("01", 4, 1, 1, [["※ 참고"]], False), ("01", 5, 3, 2, [["", " "], ["x", ""], ["", ""]], False), ("01", 6, 2, 2, [["이름", "값"], ["", ""]], True), ("01", 7, 1, 1, [["z"]], False),
    ("01", 8, 1, 2, [["◆ 작성 취지 및 방법 ◆", "작성방법 먼저 작성 취지 나중"]], False), ("01", 9, 2, 3, [["a", "b", "c"], ["1", "2", ""]], False),
]

MESSAGES = [
    (1, "API key not valid"), (2, "Your prepayment credits are depleted"), (3, "Quota exceeded: requests_per_day, limit: 250"), (4, "This model is no longer available. Please update your code to use models/x-3.5-flash-lite"),
    (5, "use models/y-preview or models/z"), (6, "slow down"), (7, None), (8, "use models/..evil"),
]


def _zip(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


_SHEET = '<worksheet xmlns="m"><sheetData>{}</sheetData></worksheet>'
XLSX = {
    "xl/workbook.xml": '<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="B" r:id="i2"/><sheet name="A" r:id="i1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="p"><Relationship Id="i1" Target="worksheets/sheet1.xml"/><Relationship Id="i2" Target="/xl/worksheets/../worksheets/sheet2.xml"/></Relationships>',
    "xl/worksheets/sheet1.xml": _SHEET.format('<row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row><c r="B2" t="b"><v>1</v></c></row>'),
    "xl/worksheets/sheet2.xml": _SHEET.format('<row><c r="A1" t="inlineStr"><is><t>둘</t></is></c></row>'),
    "xl/sharedStrings.xml": '<sst xmlns="m"><si><r><t>머</t></r><r><t>리</t></r><rPh><t>x</t></rPh></si></sst>',
}
XLSX["xl/_rels/workbook.xml.rels"] = XLSX["xl/_rels/workbook.xml.rels"].replace("/xl/worksheets/../worksheets/", "../xl/worksheets/")
_SLIDE = '<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>{}</a:t></a:r><a:br/><a:r><a:t>line</a:t></a:r></a:p><a:tbl><a:tr><a:tc><a:p><a:r><a:t>c1</a:t></a:r></a:p></a:tc><a:tc><a:p><a:r><a:t>c2</a:t></a:r></a:p></a:tc></a:tr></a:tbl></p:sld>'
_SECTION = '<hs:sec xmlns:hs="s" xmlns:hp="p"><hp:p><hp:run><hp:t>본문 하나</hp:t></hp:run></hp:p><hp:p><hp:run><hp:tbl><hp:tr><hp:tc><hp:subList><hp:p><hp:run><hp:t>머리</hp:t></hp:run></hp:p></hp:subList></hp:tc></hp:tr><hp:tr><hp:tc><hp:subList><hp:p><hp:run><hp:t>값|둘</hp:t></hp:run></hp:p></hp:subList></hp:tc></hp:tr></hp:tbl></hp:run></hp:p></hs:sec>'


def files() -> list[tuple[str, bytes]]:
    return [
        ("a.csv", '﻿x;y\r\n"p;q";"l1\nl2"\n;\nz'.encode()), ("b.html", b"<p>A &amp; B &#x41; &#999999999; &nope;</p><script>x</script><p>C<table><tr><td colspan=2>c<td>d</tr><tr><td>e</table><noscript>n</noscript>"), ("c.xlsx", _zip(XLSX)),
        ("d.pptx", _zip({"ppt/slides/slide10.xml": _SLIDE.format("ten"), "ppt/slides/slide2.xml": _SLIDE.format("two")})), ("e.txt", "가나\r\n다".encode("euc-kr")), ("f.PNG", b"12"), ("g.exe", b"1"), ("h.csv", b""),
        ("i.xlsx", b"broken"), ("j.hwp", bytes.fromhex("d0cf11e0a1b11ae1")), ("k.hwpx", _zip({"Contents/section0.xml": _SECTION})), ("l", b"none"),
    ]


SERIES = [
    '{"code": "A", "name": "하나", "unit": "", "years": [2020, 2021, 2022], "values": {"11": [1, null, 2.5], "12": [2, 3, 4]}}',
    '{"code": "B", "name": "둘", "unit": "%", "years": [2020], "values": {"11": [null]}}',
]

_HEADER = (
    '<hh:head xmlns:hh="h" xmlns:hc="c"><hh:borderFill id="1"/><hh:charPr id="0" height="1000"/><hh:charPr id="1" height="1600"><hh:bold/></hh:charPr><hh:paraPr id="0"/>'
    '<hh:paraPr id="3"><hh:margin><hc:left value="500"/></hh:margin></hh:paraPr><hh:style id="1" name="제목" paraPrIDRef="0" charPrIDRef="1"/><hh:style id="2" name="요약_원" paraPrIDRef="3" charPrIDRef="0"/>'
    '<hh:style id="17" name="주, 자료" paraPrIDRef="0" charPrIDRef="0"/></hh:head>'
)
_BODY = (
    '<hs:sec xmlns:hs="s" xmlns:hp="p"><hp:p styleIDRef="1" paraPrIDRef="0"><hp:run charPrIDRef="1"><hp:t>가. 목표 &amp; 전략</hp:t></hp:run></hp:p>'
    '<hp:p styleIDRef="2" paraPrIDRef="3"><hp:run charPrIDRef="0"><hp:t>돌봄<hp:tab/>확충</hp:t><hp:footNote><hp:p><hp:run><hp:t>근거</hp:t></hp:run></hp:p></hp:footNote><hp:t> 끝</hp:t></hp:run></hp:p><hp:p styleIDRef="2" paraPrIDRef="3"><hp:run/></hp:p>'
    '<hp:p styleIDRef="0" paraPrIDRef="9"><hp:run charPrIDRef="0"><hp:tbl rowCnt="2" colCnt="2" borderFillIDRef="7"><hp:tr><hp:tc><hp:subList><hp:p><hp:run><hp:t>머리</hp:t></hp:run></hp:p></hp:subList><hp:cellAddr colAddr="0" rowAddr="0"/>'
    '<hp:cellSpan colSpan="2" rowSpan="1"/><hp:cellSz width="400"/></hp:tc></hp:tr><hp:tr><hp:tc><hp:subList><hp:p><hp:run><hp:t>a</hp:t></hp:run></hp:p></hp:subList><hp:cellAddr colAddr="0" rowAddr="1"/><hp:cellSpan colSpan="1" rowSpan="1"/>'
    '<hp:cellSz width="300"/></hp:tc><hp:tc><hp:subList><hp:p><hp:run><hp:t>b</hp:t></hp:run></hp:p></hp:subList><hp:cellAddr colAddr="1" rowAddr="1"/><hp:cellSpan colSpan="1" rowSpan="1"/><hp:cellSz width="100"/></hp:tc></hp:tr></hp:tbl></hp:run></hp:p>'
    '<hp:p styleIDRef="17" paraPrIDRef="0"><hp:run charPrIDRef="0"><hp:t>자료: 통계</hp:t></hp:run></hp:p><hp:p styleIDRef="2" paraPrIDRef="3"><hp:run charPrIDRef="0"><hp:t>○ 이중</hp:t></hp:run></hp:p><hp:p styleIDRef="5" paraPrIDRef="0"><hp:run charPrIDRef="4"><hp:t>남</hp:t></hp:run></hp:p></hs:sec>'
)
_COVER = '<hs:sec xmlns:hs="s" xmlns:hp="p"><hp:p styleIDRef="1" paraPrIDRef="0"><hp:run><hp:t>표지</hp:t></hp:run></hp:p></hs:sec>'


def packages() -> list[tuple[str, bytes]]:
    whole = {"mimetype": "application/hwp+zip", "Contents/header.xml": _HEADER, "Contents/section0.xml": _COVER, "Contents/section1.xml": _BODY, "Contents/content.hpf": "<a/>", "META-INF/container.xml": "<a/>"}
    broken = {"Contents/header.xml": _HEADER, "mimetype": "x", "Contents/section0.xml": "<a><b></a>", "META-INF/container.xml": "<a/>"}
    return [("a.hwpx", _zip(whole)), ("b.hwpx", _zip(broken)), ("c.hwp", bytes.fromhex("d0cf11e0a1b11ae1")), ("d.hwpx", b"none")]


CATALOG = (
    '{"nodes": [{"id": "01", "depth": 0, "no": "01", "title": "목표", "parent": null, "children": ["01-가"], "forms": [{"idx": 0, "seq": 3, "kind": "blank", "rows": 2, "cols": 1, "header": ["a"], "required": true}], '
    '"limits": [{"text": "전략 5개 이내", "scope": "전략", "op": "max", "n": 5, "unit": "개"}]}, {"id": "01-가", "depth": 1, "no": "가", "title": "절", "parent": "01", "children": []}]}'
)
INDEX = ('{"items": [{"code": "A", "name": "하나", "unit": "%", "area": "a", "area_name": "영역"}], "type7_labels": {"1": "대도시"}}', '[{"code": "11", "level": "시도", "sido": "서울"}, {"code": "11010", "level": "시군구", "sido": "서울", "sigungu": "종로구", "type7": 1}]')

GUIDE = [
    # line, style, text, grid, a chapter's banner
    (0, 0, "머리말", None, None), (1, 0, "", None, ("제1절", "목표")), (2, 1, "가. 전략", None, None), (3, 0, "", [["◆ 작성 취지 및 방법 ◆"], ["작성 취지: 왜"], ["작성방법: 추진전략 5개 이내"]], None), (4, 2, "1) 세부", None, None),
    (5, 4, "쓴다", None, None), (6, 4, "또 쓴다", None, None), (7, 5, "수정 불가", None, None), (8, 0, "", [["이름", "값"], ["", ""]], None), (9, 0, "작성양식 및 예시", None, None), (10, 0, "", [["이름", "값"], ["", ""]], None),
    (11, 1, "나. 전략", None, None), (12, 1, "그냥 글", None, None), (13, 2, "1) 세부", None, None), (14, 1, "나. 다시", None, None), (15, 0, "", None, ("제2절", "목표")), (16, 1, "[첨부 1] 표", None, None), (17, 10, "(1) 깊이", None, None), (18, 0, "", [["a", "b"], ["1", "2"]], None),
]
