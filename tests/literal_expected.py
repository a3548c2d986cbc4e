"""What the fixtures must give, worked out from the rules by hand and held against every run: literal rows in the order of their keys."""

# Expected results.
EXPECTED: dict[str, tuple[str, list[tuple]]] = {
    "marker_blocks": (
        "id VARCHAR, line INTEGER, kind VARCHAR, level VARCHAR, text VARCHAR, rows VARCHAR, caption VARCHAR, cols VARCHAR, name VARCHAR",
        [
            ('01-가', 2, 'para', 'h1', '비전과 목표', None, None, None, None),
            ('01-가', 3, 'blank', None, '', None, None, None, None),
            ('01-가', 4, 'para', 'b1', '함께 사는 복지 도시[^1]', None, None, None, None),
            ('01-가', 5, 'para', 'b3', '이용자 1,200 명, 만족도 87.5%', None, None, None, None),
            ('01-가', 6, 'para', 'b2', '세부사업 3개', None, None, None, None),
            ('01-가', 7, 'table_note', None, '자료: 내부', None, None, None, None),
            ('01-가', 9, 'table', None, '', '전략|과제/돌봄 사업|확충', '', '1,2', None),
            ('01-가', 12, 'blank', None, '', None, None, None, None),
            ('01-가', 13, 'table', None, '', '자립 지원|연계|남음', '', None, None),
            ('01-가', 14, 'para', 'b4', '본문이 이어진다', None, None, None, None),
            ('01-나', 1, 'para', 'h2', '추진전략', None, None, None, None),
            ('01-나', 2, 'para', 'h4', '너무 깊은 제목', None, None, None, None),
            ('01-나', 3, 'para', 'b1', '첫째 [^2] 그다음 줄', None, None, None, None),
            ('01-나', 5, 'table', None, '', 'a|b/1|', '', None, None),
            ('01-나', 7, 'para', 'b4', '끝', None, None, None, None),
            ('01-나', 9, 'para', 'b3', '문장. [^3]', None, None, None, None),
            ('02-가', 1, 'para', 'h1', '예산', None, None, None, None),
            ('02-가', 2, 'blank', None, '', None, None, None, None),
            ('02-가', 7, 'table', None, '', '연도|억원/2024|10', '연도별', '3,1', None),
            ('02-가', 10, 'table_note', None, '단위: 억원', None, None, None, None),
            ('02-가', 11, 'blank', None, '', None, None, None, None),
            ('02-가', 12, 'image', None, '', None, None, None, 'chart.png'),
            ('02-가', 13, 'blank', None, '', None, None, None, None),
            ('02-가', 14, 'para', 'b3', '30억원과 30 억원', None, None, None, None),
        ],
    ),
    "marker_footnotes": (
        "id VARCHAR, line INTEGER, label VARCHAR, note VARCHAR, offset INTEGER, before VARCHAR, after VARCHAR, number INTEGER, use INTEGER",
        [
            ('01-가', 4, '1', '조례', 11, '시', '', 1, 1),
            ('01-나', 3, '2', None, 3, ' ', ' ', None, None),
            ('01-나', 9, '3', '셋', 4, ' ', '', 1, 1),
        ],
    ),
    "marker_issues": (
        "id VARCHAR, line INTEGER, issue VARCHAR",
        [
            ('01-가', 4, 'level passed over'),
            ('01-가', 5, 'level passed over'),
            ('01-가', 7, 'table note without a table'),
            ('01-가', 9, 'no blank line before a table'),
            ('01-가', 13, 'no blank line after a table'),
            ('01-가', 14, 'level passed over'),
            ('01-가', 14, 'line without a marker'),
            ('01-나', 2, 'level passed over'),
            ('01-나', 3, 'footnote without a definition'),
            ('01-나', 4, 'line without a marker'),
            ('01-나', 5, 'no blank line after a table'),
            ('01-나', 5, 'no blank line before a table'),
            ('01-나', 5, 'row of another width'),
            ('01-나', 7, 'level passed over'),
            ('01-나', 7, 'line without a marker'),
            ('01-나', 9, 'caption without a table'),
            ('01-나', 9, 'footnote out of order'),
            ('01-나', 9, 'space before a footnote'),
            ('01-나', 11, 'footnote never used'),
            ('02-가', 14, 'level passed over'),
        ],
    ),
    "issue_tally": (
        "id VARCHAR, issue VARCHAR, n BIGINT",
        [
            ('01-가', 'level passed over', 3),
            ('01-가', 'line without a marker', 1),
            ('01-가', 'no blank line after a table', 1),
            ('01-가', 'no blank line before a table', 1),
            ('01-가', 'table note without a table', 1),
            ('01-나', 'caption without a table', 1),
            ('01-나', 'footnote never used', 1),
            ('01-나', 'footnote out of order', 1),
            ('01-나', 'footnote without a definition', 1),
            ('01-나', 'level passed over', 2),
            ('01-나', 'line without a marker', 2),
            ('01-나', 'no blank line after a table', 1),
            ('01-나', 'no blank line before a table', 1),
            ('01-나', 'row of another width', 1),
            ('01-나', 'space before a footnote', 1),
            ('02-가', 'level passed over', 1),
        ],
    ),
    "marker_chapters": (
        "id VARCHAR, chapter VARCHAR",
        [
            ('01-가', '1'),
        ],
    ),
    "bar_tables": (
        "id VARCHAR, ln INTEGER, cells VARCHAR",
        [
            ('01-가', 8, '전략|과제|'),
            ('01-가', 10, '돌봄 사업|확충|'),
            ('01-가', 12, '자립 지원|연계|남음'),
            ('01-나', 4, 'a|b'),
            ('01-나', 5, '1|'),
            ('02-가', 6, '연도|억원'),
            ('02-가', 8, '2024|10'),
        ],
    ),
    "table_shapes": (
        "id VARCHAR, nth INTEGER, header VARCHAR, cols INTEGER, n INTEGER",
        [
            ('01-가', 1, '전략|과제', 3, 3),
            ('01-나', 1, 'a|b', 2, 2),
            ('02-가', 1, '연도|억원', 2, 2),
        ],
    ),
    "form_issues": (
        "id VARCHAR, nth INTEGER, level VARCHAR, issue VARCHAR",
        [
            ('01-가', 0, 'err', '1 of 2 tables'),
            ('01-가', 1, 'err', '3 columns instead of 2'),
            ('02-가', 1, 'err', '2 columns instead of 3'),
            ('02-가', 1, 'warn', 'missing: 예산'),
        ],
    ),
    "card_texts": (
        "id VARCHAR, heads VARCHAR, card VARCHAR",
        [
            ('01-가', '비전과 목표', '◆ 가. 목표와 전략 (01-가)\n  - 확정된 이름: 비전과 목표 / 세부사업 3개 / 돌봄 사업\n  - 함께 사는 복지 도시[^1]\n  - 표 2열: 전략 | 과제 (첫 칸: 돌봄 사업, 자립 지원)\n  - 수치: 1,200명, 87.5%, 3개'),
            ('01-나', '추진전략/너무 깊은 제목', '◆ 나. 추진 체계 (01-나)\n  - 확정된 이름: 추진전략\n  - 첫째 [^2]\n  - 표 2열: a | b (첫 칸: 1)'),
            ('02-가', '예산', '◆ 가. 재정 (02-가)\n  - 표 2열: 연도 | 억원 (첫 칸: 2024)\n  - 수치: 30억원'),
            ('02-나', '', '◆ 나. 빈 원고 (02-나)'),
        ],
    ),
    "card_context": (
        "target VARCHAR, context VARCHAR",
        [
            ('01-가-1', '[앞서 작성한 절의 결정 사항]\n※ 이 계획서의 앞선 절에서 이미 확정한 내용이다. 비전·전략 이름·사업명·수치를 여기에\n   맞춰 쓴다. 달리 써야 할 이유가 있으면 그 이유를 본문에 밝힌다. 아래 내용을 그대로\n   옮겨 적지는 말고, 이 절이 맡은 몫만 쓴다.\n\n◆ 가. 목표와 전략 (01-가)\n  - 확정된 이름: 비전과 목표 / 세부사업 3개 / 돌봄 사업\n  - 함께 사는 복지 도시[^1]\n  - 표 2열: 전략 | 과제 (첫 칸: 돌봄 사업, 자립 지원)\n  - 수치: 1,200명, 87.5%, 3개'),
            ('01-나', '[앞서 작성한 절의 결정 사항]\n※ 이 계획서의 앞선 절에서 이미 확정한 내용이다. 비전·전략 이름·사업명·수치를 여기에\n   맞춰 쓴다. 달리 써야 할 이유가 있으면 그 이유를 본문에 밝힌다. 아래 내용을 그대로\n   옮겨 적지는 말고, 이 절이 맡은 몫만 쓴다.\n\n◆ 가. 목표와 전략 (01-가)\n  - 확정된 이름: 비전과 목표 / 세부사업 3개 / 돌봄 사업\n  - 함께 사는 복지 도시[^1]\n  - 표 2열: 전략 | 과제 (첫 칸: 돌봄 사업, 자립 지원)\n  - 수치: 1,200명, 87.5%, 3개'),
            ('02', '[앞서 작성한 절의 결정 사항]\n※ 이 계획서의 앞선 절에서 이미 확정한 내용이다. 비전·전략 이름·사업명·수치를 여기에\n   맞춰 쓴다. 달리 써야 할 이유가 있으면 그 이유를 본문에 밝힌다. 아래 내용을 그대로\n   옮겨 적지는 말고, 이 절이 맡은 몫만 쓴다.\n\n◆ 가. 목표와 전략 (01-가)\n  - 확정된 이름: 비전과 목표 / 세부사업 3개 / 돌봄 사업\n  - 함께 사는 복지 도시[^1]\n  - 표 2열: 전략 | 과제 (첫 칸: 돌봄 사업, 자립 지원)\n  - 수치: 1,200명, 87.5%, 3개\n◆ 나. 추진 체계 (01-나)\n  - 확정된 이름: 추진전략\n  - 첫째 [^2]\n  - 표 2열: a | b (첫 칸: 1)'),
            ('02-가', '[앞서 작성한 절의 결정 사항]\n※ 이 계획서의 앞선 절에서 이미 확정한 내용이다. 비전·전략 이름·사업명·수치를 여기에\n   맞춰 쓴다. 달리 써야 할 이유가 있으면 그 이유를 본문에 밝힌다. 아래 내용을 그대로\n   옮겨 적지는 말고, 이 절이 맡은 몫만 쓴다.\n\n◆ 가. 목표와 전략 (01-가)\n  - 확정된 이름: 비전과 목표 / 세부사업 3개 / 돌봄 사업\n  - 함께 사는 복지 도시[^1]\n  - 표 2열: 전략 | 과제 (첫 칸: 돌봄 사업, 자립 지원)\n  - 수치: 1,200명, 87.5%, 3개\n◆ 나. 추진 체계 (01-나)\n  - 확정된 이름: 추진전략\n  - 첫째 [^2]\n  - 표 2열: a | b (첫 칸: 1)'),
            ('03', '[앞서 작성한 절의 결정 사항]\n※ 이 계획서의 앞선 절에서 이미 확정한 내용이다. 비전·전략 이름·사업명·수치를 여기에\n   맞춰 쓴다. 달리 써야 할 이유가 있으면 그 이유를 본문에 밝힌다. 아래 내용을 그대로\n   옮겨 적지는 말고, 이 절이 맡은 몫만 쓴다.\n\n◆ 가. 목표와 전략 (01-가)\n  - 확정된 이름: 비전과 목표 / 세부사업 3개 / 돌봄 사업\n  - 함께 사는 복지 도시[^1]\n  - 표 2열: 전략 | 과제 (첫 칸: 돌봄 사업, 자립 지원)\n  - 수치: 1,200명, 87.5%, 3개\n◆ 나. 추진 체계 (01-나)\n  - 확정된 이름: 추진전략\n  - 첫째 [^2]\n  - 표 2열: a | b (첫 칸: 1)\n◆ 가. 재정 (02-가)\n  - 표 2열: 연도 | 억원 (첫 칸: 2024)\n  - 수치: 30억원'),
            ('04-가', '[앞서 작성한 절의 결정 사항]\n※ 이 계획서의 앞선 절에서 이미 확정한 내용이다. 비전·전략 이름·사업명·수치를 여기에\n   맞춰 쓴다. 달리 써야 할 이유가 있으면 그 이유를 본문에 밝힌다. 아래 내용을 그대로\n   옮겨 적지는 말고, 이 절이 맡은 몫만 쓴다.\n\n◆ 가. 목표와 전략 (01-가)\n  - 확정된 이름: 비전과 목표 / 세부사업 3개 / 돌봄 사업\n  - 함께 사는 복지 도시[^1]\n  - 표 2열: 전략 | 과제 (첫 칸: 돌봄 사업, 자립 지원)\n  - 수치: 1,200명, 87.5%, 3개\n◆ 나. 추진 체계 (01-나)\n  - 확정된 이름: 추진전략\n  - 첫째 [^2]\n  - 표 2열: a | b (첫 칸: 1)\n◆ 가. 재정 (02-가)\n  - 표 2열: 연도 | 억원 (첫 칸: 2024)\n  - 수치: 30억원'),
            ('05', '[앞서 작성한 절의 결정 사항]\n※ 이 계획서의 앞선 절에서 이미 확정한 내용이다. 비전·전략 이름·사업명·수치를 여기에\n   맞춰 쓴다. 달리 써야 할 이유가 있으면 그 이유를 본문에 밝힌다. 아래 내용을 그대로\n   옮겨 적지는 말고, 이 절이 맡은 몫만 쓴다.\n\n◆ 가. 목표와 전략 (01-가)\n  - 확정된 이름: 비전과 목표 / 세부사업 3개 / 돌봄 사업\n  - 함께 사는 복지 도시[^1]\n  - 표 2열: 전략 | 과제 (첫 칸: 돌봄 사업, 자립 지원)\n  - 수치: 1,200명, 87.5%, 3개\n◆ 나. 추진 체계 (01-나)\n  - 확정된 이름: 추진전략\n  - 첫째 [^2]\n  - 표 2열: a | b (첫 칸: 1)\n◆ 가. 재정 (02-가)\n  - 표 2열: 연도 | 억원 (첫 칸: 2024)\n  - 수치: 30억원'),
            ('06', '[앞서 작성한 절의 결정 사항]\n※ 이 계획서의 앞선 절에서 이미 확정한 내용이다. 비전·전략 이름·사업명·수치를 여기에\n   맞춰 쓴다. 달리 써야 할 이유가 있으면 그 이유를 본문에 밝힌다. 아래 내용을 그대로\n   옮겨 적지는 말고, 이 절이 맡은 몫만 쓴다.\n\n◆ 가. 목표와 전략 (01-가)\n  - 확정된 이름: 비전과 목표 / 세부사업 3개 / 돌봄 사업\n  - 함께 사는 복지 도시[^1]\n  - 표 2열: 전략 | 과제 (첫 칸: 돌봄 사업, 자립 지원)\n  - 수치: 1,200명, 87.5%, 3개\n◆ 나. 추진 체계 (01-나)\n  - 확정된 이름: 추진전략\n  - 첫째 [^2]\n  - 표 2열: a | b (첫 칸: 1)\n◆ 가. 재정 (02-가)\n  - 표 2열: 연도 | 억원 (첫 칸: 2024)\n  - 수치: 30억원'),
        ],
    ),
    "section_instructions": (
        "id VARCHAR, ref VARCHAR",
        [
            ('01', '01-가-1'),
            ('01-가', '01-가-1'),
            ('01-가-1', None),
            ('01-나', '01-가-1'),
            ('02', None),
            ('02-가', '02'),
            ('03', None),
            ('04-가', None),
            ('05', None),
            ('06', None),
        ],
    ),
    "section_mirrors": (
        "id VARCHAR, mirrors VARCHAR",
        [
            ('01', None),
            ('01-가', None),
            ('01-가-1', None),
            ('01-나', '01-가'),
            ('02', None),
            ('02-가', None),
            ('03', None),
            ('04-가', None),
            ('05', None),
            ('06', None),
        ],
    ),
    "section_problems": (
        "id VARCHAR, problem VARCHAR",
        [
            ('03', 'repeated id'),
            ('04-가', 'unknown parent'),
            ('05', 'cycle'),
            ('06', 'cycle'),
        ],
    ),
    "section_order": (
        "id VARCHAR, pos INTEGER, depth INTEGER, trail VARCHAR",
        [
            ('01', 1, 0, '목표'),
            ('01-가', 2, 1, '목표 › [사회보장 전략 1_돌봄]'),
            ('01-가-1', 3, 2, '목표 › [사회보장 전략 1_돌봄] › 세부'),
            ('01-나', 4, 1, '목표 › [사회보장 전략 2_자립]'),
            ('02', 5, 0, '재정'),
            ('02-가', 6, 1, '재정 › 목표'),
            ('03', 7, 0, '점검'),
            ('04-가', 8, 0, '고아'),
            ('05', 9, 0, '고리'),
            ('06', 10, 0, '고리'),
        ],
    ),
    "section_stats": (
        "chapters BIGINT, nodes BIGINT, forms BIGINT, howtos BIGINT",
        [
            (3, 10, 4, 2),
        ],
    ),
    "table_kinds": (
        "id VARCHAR, seq INTEGER, kind VARCHAR, filled DOUBLE, purpose VARCHAR, method VARCHAR",
        [
            ('01', 1, 'howto', 0.5, ': 왜', ': 어떻게'),
            ('01', 2, 'blank', 0.5, None, None),
            ('01', 3, 'example', 1.0, None, None),
            ('01', 4, 'note', 1.0, None, None),
            ('01', 5, 'layout', 0.1667, None, None),
            ('01', 6, 'example', 0.5, None, None),
            ('01', 7, 'example', 1.0, None, None),
            ('01', 8, 'howto', 1.0, '나중', '먼저'),
            ('01', 9, 'example', 0.8333, None, None),
        ],
    ),
    "blank_forms": (
        "id VARCHAR, nth INTEGER, idx INTEGER",
        [
            ('a', 0, 1),
            ('a', 1, 2),
            ('c', 0, 0),
            ('c', 1, 3),
        ],
    ),
    "headings": (
        "depth INTEGER, line VARCHAR, no VARCHAR, title VARCHAR",
        [
            (1, '1) 아님', None, None),
            (1, '[첨부 2] 자료', '첨부2', '자료'),
            (1, '가. 목표', '가', '목표'),
            (2, ' 3) 세부 ', '3', '세부'),
            (3, '(4) 더', '(4)', '더'),
            (3, '4) 아님', None, None),
        ],
    ),
    "contents": (
        "line VARCHAR, chapter INTEGER, page INTEGER",
        [
            ('01제6기 방향  _ 76', 1, 76),
            ('02재정_80', 2, 80),
            ('머리말 _ 3', None, None),
        ],
    ),
    "message_faults": (
        "id INTEGER, fault VARCHAR, limit BIGINT, instead VARCHAR",
        [
            (1, 'key', 0, ''),
            (2, 'billing', 0, ''),
            (3, 'daily', 250, ''),
            (4, 'retired', 0, 'x-3.5-flash-lite'),
            (5, 'other', 0, ''),
            (6, 'other', 0, ''),
            (7, 'other', 0, ''),
            (8, 'other', 0, ''),
        ],
    ),
    "number_formats": (
        "i INTEGER, amount VARCHAR, reference VARCHAR, plain VARCHAR",
        [
            (0, '0.12 %', '0.12', '0.12'),
            (1, '12.5 %', '12.50', '12.50'),
            (2, '250.44 %', '250.4', '250.4'),
            (3, '1.01 %', '1.00', '1.00'),
            (4, '1,234.56 %', '1,235', '1,235'),
            (5, '3.4억 %', '3.4억', '340,000,000'),
            (6, '5.1조 %', '5.1조', '5,100,000,000,000'),
            (7, '-0.01 %', '-0.01', '-0.01'),
            (8, '-1,234.5 %', '-1,235', '-1,235'),
            (9, '999.95 %', '1000.0', '1000.0'),
            (10, '—', '–', '–'),
            (11, '—', '–', '–'),
        ],
    ),
    "axis_ticks": (
        "i INTEGER, nth INTEGER, tick DOUBLE",
        [
            (1, 0, -3.0),
            (1, 1, -2.0),
            (1, 2, -1.0),
            (1, 3, 0.0),
            (1, 4, 1.0),
            (2, 0, 0.0),
            (3, 0, 0.0),
            (3, 1, 20.0),
            (3, 2, 40.0),
            (3, 3, 60.0),
            (3, 4, 80.0),
            (3, 5, 100.0),
            (4, 0, 0.014),
            (4, 1, 0.016),
            (4, 2, 0.018),
        ],
    ),
    "text_tools": (
        "what VARCHAR, result VARCHAR",
        [
            ('after a final', '은'),
            ('after a vowel', '는'),
            ('archive path', 'a/b'),
            ('attrs text', '기획부'),
            ('bar table', '| a∣b | c |\n| d |   |'),
            ('basis', '광역(시·도) 내'),
            ('bullet', '·'),
            ('cell', 'a∣b c'),
            ('chapter', '03'),
            ('clip', 'a b…'),
            ('column', '54'),
            ('crc32', '3421780262'),
            ('diagram', 'a b'),
            ('diagram option', '2'),
            ('diagram type', 'org'),
            ('empty cell', ' '),
            ('extension', 'txt'),
            ('fence', 'hi'),
            ('file name', 'a_b__c'),
            ('fill', '#DDCCEE'),
            ('fits', '가나'),
            ('header', 'a b | '),
            ('least', '항목: 몇개 이상 쓴다'),
            ('limit', '전략: 5개 이내로 쓴다. 안내서 원문 — “전략 5개 이내”'),
            ('lines', '3'),
            ('link', 'DASH'),
            ('no bullet', ''),
            ('no color', None),
            ('no column', '-1'),
            ('no extension', ''),
            ('no header', None),
            ('no lines', '0'),
            ('root path', 'xl/c'),
            ('round half even', '2'),
            ('short', '가나…'),
            ('shown', '가나'),
            ('square', '□'),
            ('units', '3'),
            ('unknown basis', 'planet'),
            ('width', '27.8'),
        ],
    ),
    "indent_tree": (
        "id VARCHAR, ln INTEGER, parent INTEGER, depth INTEGER, text VARCHAR, attrs VARCHAR",
        [
            ('a', 0, None, 0, '본부', '#123456'),
            ('a', 1, 0, 1, '기획과', ''),
            ('a', 2, 1, 2, '팀', ''),
            ('a', 3, 0, 1, '재무과', ''),
            ('a', 5, None, 0, '지부', ''),
            ('a', 6, 5, 1, '먼 팀', ''),
            ('a', 7, 5, 1, '가까운 팀', ''),
        ],
    ),
    "diagram_relations": (
        "id VARCHAR, a VARCHAR, b VARCHAR, state VARCHAR",
        [
            ('d', 'a', 'b', 'right'),
            ('d', 'a', 'c', 'apart'),
            ('d', 'a', 'q', 'unknown'),
            ('d', 'c', 'b', 'left'),
        ],
    ),
    "package_entries": (
        "id INTEGER, missing VARCHAR, placed VARCHAR, lost VARCHAR",
        [
            (1, 'META-INF/container.xml', 'k1', 'k2,k3'),
            (2, '', '', 'k'),
        ],
    ),
    "attachment_files": (
        "name VARCHAR, ext VARCHAR, mode VARCHAR, text VARCHAR, tables VARCHAR, inline VARCHAR, failed BOOLEAN",
        [
            ('a.csv', 'csv', 'text', '', 'x|y/p;q|l1\nl2/z|', None, False),
            ('b.html', 'html', 'text', 'A & B A &#999999999; &nope;\nC', 'c||d/e||', None, False),
            ('c.xlsx', 'xlsx', 'text', '', '둘 # 머리||7/|TRUE|', None, False),
            ('d.pptx', 'pptx', 'text', 'two\nline\nten\nline', 'c1|c2 # c1|c2', None, False),
            ('e.txt', 'txt', 'text', '가나\n다', '', None, False),
            ('f.PNG', 'png', 'inline', None, None, 'MTI=', False),
            ('g.exe', 'exe', None, None, None, None, True),
            ('h.csv', 'csv', None, None, None, None, True),
            ('i.xlsx', 'xlsx', None, None, None, None, True),
            ('j.hwp', 'hwp', None, None, None, None, True),
            ('k.hwpx', 'hwpx', 'text', '본문 하나\n| 머리 |\n|---|\n| 값∣둘 |', '머리/값|둘', None, False),
            ('l', '', None, None, None, None, True),
        ],
    ),
    "series_files": (
        "code VARCHAR, name VARCHAR, unit VARCHAR, place VARCHAR, year INTEGER, value DOUBLE",
        [
            ('A', '하나', '', '11', 2020, 1.0),
            ('A', '하나', '', '11', 2021, None),
            ('A', '하나', '', '11', 2022, 2.5),
            ('A', '하나', '', '12', 2020, 2.0),
            ('A', '하나', '', '12', 2021, 3.0),
            ('A', '하나', '', '12', 2022, 4.0),
            ('B', '둘', '%', '11', 2020, None),
        ],
    ),
    "package_paragraphs": (
        "name VARCHAR, part VARCHAR, ln INTEGER, style INTEGER, para INTEGER, char INTEGER, kind VARCHAR, text VARCHAR, notes VARCHAR, cells VARCHAR, widths VARCHAR, failed BOOLEAN",
        [
            ('a.hwpx', 'Contents/section0.xml', 0, 1, 0, None, 'para', '표지', '', None, None, False),
            ('a.hwpx', 'Contents/section1.xml', 0, 1, 0, 1, 'para', '가. 목표 & 전략', '', None, None, False),
            ('a.hwpx', 'Contents/section1.xml', 1, 2, 3, 0, 'para', '돌봄 확충 끝', '근거', None, None, False),
            ('a.hwpx', 'Contents/section1.xml', 2, 2, 3, None, 'para', '', '', None, None, False),
            ('a.hwpx', 'Contents/section1.xml', 3, 0, 9, 0, 'table', '', '', '머리|/a|b', '75,25', False),
            ('a.hwpx', 'Contents/section1.xml', 4, 17, 0, 0, 'para', '자료: 통계', '', None, None, False),
            ('a.hwpx', 'Contents/section1.xml', 5, 2, 3, 0, 'para', '○ 이중', '', None, None, False),
            ('a.hwpx', 'Contents/section1.xml', 6, 5, 0, 4, 'para', '남', '', None, None, False),
            ('b.hwpx', None, None, None, None, None, None, None, None, None, None, True),
            ('c.hwp', None, None, None, None, None, None, None, None, None, None, True),
            ('d.hwpx', None, None, None, None, None, None, None, None, None, None, True),
        ],
    ),
    "package_styles": (
        "name VARCHAR, style INTEGER, title VARCHAR, para INTEGER, char INTEGER, size DOUBLE, bold BOOLEAN, left DOUBLE",
        [
            ('a.hwpx', 1, '제목', 0, 1, 16.0, True, 0.0),
            ('a.hwpx', 2, '요약_원', 3, 0, 10.0, False, 5.0),
            ('a.hwpx', 17, '주, 자료', 0, 0, 10.0, False, 0.0),
            ('b.hwpx', 1, '제목', 0, 1, 16.0, True, 0.0),
            ('b.hwpx', 2, '요약_원', 3, 0, 10.0, False, 5.0),
            ('b.hwpx', 17, '주, 자료', 0, 0, 10.0, False, 0.0),
        ],
    ),
    "package_verdict": (
        "name VARCHAR, problem VARCHAR",
        [
            ('b.hwpx', 'Contents/section0.xml: no well-formed XML'),
            ('b.hwpx', "mimetype isn't the first entry"),
            ('b.hwpx', 'missing: Contents/content.hpf'),
            ('c.hwp', "can't be opened"),
            ('d.hwpx', "can't be opened"),
        ],
    ),
    "package_text": (
        "name VARCHAR, text VARCHAR, ratio DOUBLE",
        [
            ('a.hwpx', '# 가. 목표 & 전략\n○ 돌봄 확충 끝\n\n{cols=75,25}\n| 머리 |   |\n|---|---|\n| a | b |\n※ 자료: 통계\n○ ○ 이중\n남\n', 0.8),
        ],
    ),
    "package_references": (
        "name VARCHAR, attr VARCHAR, missing VARCHAR",
        [
            ('a.hwpx', 'borderFillIDRef', '7'),
            ('a.hwpx', 'charPrIDRef', '4'),
            ('a.hwpx', 'paraPrIDRef', '9'),
            ('a.hwpx', 'styleIDRef', '0,5'),
        ],
    ),
    "package_bullets": (
        "name VARCHAR, ln INTEGER, bullet VARCHAR, text VARCHAR",
        [
            ('a.hwpx', 5, '○', '○ 이중'),
        ],
    ),
    "package_style_names": (
        "name VARCHAR, style INTEGER, want VARCHAR, have VARCHAR",
        [
            ('a.hwpx', 2, '요약', '요약_원'),
            ('a.hwpx', 3, '점', None),
            ('a.hwpx', 17, '주, 자료', '주, 자료'),
            ('b.hwpx', 2, '요약', '요약_원'),
            ('b.hwpx', 3, '점', None),
            ('b.hwpx', 17, '주, 자료', '주, 자료'),
        ],
    ),
    "catalog_file": (
        "ord INTEGER, id VARCHAR, depth INTEGER, no VARCHAR, title VARCHAR, parent VARCHAR, children VARCHAR, forms INTEGER, scope VARCHAR",
        [
            (0, '01', 0, '01', '목표', None, '01-가', 1, '전략'),
            (1, '01-가', 1, '가', '절', '01', '', 0, None),
        ],
    ),
    "index_files": (
        "code VARCHAR, item VARCHAR, place VARCHAR, name VARCHAR, type_label VARCHAR",
        [
            ('A', '하나', '11', '서울', None),
            ('A', '하나', '11010', '서울 종로구', '대도시'),
        ],
    ),
    "style_issues": (
        "id VARCHAR, line INTEGER, issue VARCHAR",
        [
            ('01-가', 2, 'too little below'),
            ('01-가', 6, 'too little below'),
            ('01-나', 3, 'too little below'),
            ('01-나', 9, 'no full stop after several sentences'),
            ('02-가', 1, 'too little below'),
            ('x', 1, 'too little below'),
            ('x', 2, 'full stop after one sentence'),
            ('x', 2, 'too little below'),
            ('x', 3, 'no full stop after several sentences'),
            ('x', 5, 'marker in the text'),
            ('x', 6, 'too little below'),
        ],
    ),
    "guide_catalog": (
        "ord INTEGER, id VARCHAR, depth INTEGER, no VARCHAR, title VARCHAR, parent VARCHAR, forms BIGINT, required BIGINT, has BOOLEAN, purpose VARCHAR, method VARCHAR, fixed BOOLEAN, markers VARCHAR, limits VARCHAR",
        [
            (0, '01', 0, '제1절', '목표', None, 0, 0, False, None, None, False, '', None),
            (1, '01-가', 1, '가', '전략', '01', 1, 0, True, ': 왜', ': 추진전략 5개 이내', False, '', '추진전략 max 5 개'),
            (2, '01-가-1', 2, '1', '세부', '01-가', 2, 1, False, None, None, True, '○-', None),
            (3, '01-나', 1, '나', '전략 #2', '01', 0, 0, False, None, None, False, '', None),
            (4, '01-나-1', 2, '1', '세부 #2', '01-나', 0, 0, False, None, None, False, '', None),
            (5, '01-나_2', 1, '나', '다시', '01', 0, 0, False, None, None, False, '', None),
            (6, '02', 0, '제2절', '목표 #2', None, 0, 0, False, None, None, False, '', None),
            (7, '02-첨부1', 1, '첨부1', '표', '02', 0, 0, False, None, None, False, '', None),
            (8, '(1)', 3, '(1)', '깊이', None, 1, 0, False, None, None, False, '', None),
        ],
    ),
    "guide_forms": (
        "sec INTEGER, idx INTEGER, seq BIGINT, kind VARCHAR, rows INTEGER, cols INTEGER, header VARCHAR, filled DOUBLE",
        [
            (2, 0, 1, 'howto', 3, 1, '◆ 작성 취지 및 방법 ◆', 1.0),
            (4, 0, 2, 'blank', 2, 2, '이름|값', 0.5),
            (4, 1, 3, 'example', 2, 2, '이름|값', 0.5),
            (17, 0, 4, 'example', 2, 2, 'a|b', 1.0),
        ],
    ),
    "preferred_models": (
        "k INTEGER, name VARCHAR",
        [
            (1, 'a-pro'),
            (2, 'm-2.0-flash-lite'),
            (3, 'm-2.0-flash-lite'),
        ],
    ),
}
