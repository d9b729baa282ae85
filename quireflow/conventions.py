"""Patterns and word lists of the documents read, kept in one place.

The defaults follow Korean workbooks. An operator takes a Conventions value, so other corpora bring their own.
"""

from __future__ import annotations

from dataclasses import dataclass

# Character class for every Unicode white space character; understood by Java and by RE2 alike.
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
NOT_SPACE = r"[^\t-\r\x1c-\x20\x85\p{Z}]"
DIGIT = r"\p{Nd}"
WORD = r"[\p{L}\p{N}_]"

# The circled digits that mark choices.
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩"
EM_SPACE = " "
BLANK_BOX = ""


@dataclass(frozen=True)
class Conventions:
    guide: str = rf"^{SPACE}*(※|\[{SPACE}*{DIGIT}+{SPACE}*[~∼～\-–]{SPACE}*{DIGIT}+{SPACE}*\])"
    answer_head: str = rf"^{SPACE}*({DIGIT}{{1,3}}){SPACE}*\){SPACE}*\[?{SPACE}*정답{SPACE}*\]?"
    answer_number: str = rf"^{SPACE}*{DIGIT}{{1,3}}{SPACE}*\){SPACE}*$"
    answer_tag: str = rf"^{SPACE}*\[?{SPACE}*정답{SPACE}*\]"
    explanation: str = rf"^{SPACE}*\[{SPACE}*해설{SPACE}*\]"
    question_number: str = rf"^{SPACE}*({DIGIT}{{1,3}}){SPACE}*\.{SPACE}*{NOT_SPACE}"
    question_bare: str = rf"^{SPACE}*({DIGIT}{{1,3}}){SPACE}+{NOT_SPACE}"
    label: str = rf"^{SPACE}*(\([가-힣A-Za-z]\)|\[[A-Z가-힣]\]|<[가-힣]>){SPACE}*$"
    side_label: str = rf"^{SPACE}*\[[A-Z가-힣]\]{SPACE}*$"
    title: str = rf"^{SPACE}*[<〈＜《]{SPACE}*[^<>〈〉＜＞]{{1,14}}{SPACE}*[>〉＞》]{SPACE}*$"
    arrow: str = rf"^{SPACE}*[→⇒]"
    credit: str = rf"^{SPACE}*[-–—]{SPACE}*[^\t-\r\x1c-\x20\x85\p{{Z}}\p{{Nd}}\-–—]"
    notice: str = rf"콘텐츠{SPACE}*산업{SPACE}*진흥법|제작{SPACE}*연월일|저작권법에{SPACE}*의(?:하여|해|한)"
    writing: str = rf"(쓰시오|쓰라|적으시오|서술하시오|설명하시오|고치시오|채우시오){SPACE}*[.)]?{SPACE}*$"
    negative: str = r"(않\s?[은는]|(?<![가-힣])(?:아\s?닌|없\s?는|먼))(?=\s?것)"
    # Line starts that open a paragraph: circled or parenthesised marks, list numbers, bullets, speakers, short labels.
    marker: str = (
        rf"^{SPACE}*(?:[①-⑳]|[㉠-㉻ⓐ-ⓩ](?={SPACE}|:)|\([가-힣A-Za-z0-9]\)(?={SPACE}|$)|[ㄱ-ㅎ]{SPACE}*\.|[A-Z]{SPACE}*\."
        rf"|{DIGIT}{{1,2}}{SPACE}*\.(?!{DIGIT})|[-–—•·▪◦○●□■◇◆※]{SPACE}|[가-힣A-Za-z]{{1,6}}{SPACE}?:|S#|\[[^\]]{{1,20}}\])"
    )
    script: str = "가-힣"
    particles: tuple[str, ...] = (
        "로", "을", "를", "은", "는", "이", "가", "에", "의", "와", "과", "도", "에서", "에게", "만", "부터", "까지",
    )
    particle_syllables: str = "은을는를의이가에와과로으도만"
    endings: str = "을를은는의에로와과가이고며서도면게"


KOREAN = Conventions()
