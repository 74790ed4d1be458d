"""Pages whose text hangs on how names and attributes are read: none of them has a marked article, but the first."""

from verdance.llm import webpages

PROSE = "The council said on Monday that it would review the plan for the old bridge, because it is the only way to cross the river and many of the people who live there have to use it every day of the year."
CHINESE = "这座城市的老桥在星期一的会议上被再次讨论，因为它是过河的唯一道路，而且每天都有很多居民在使用它。市政府表示，他们将在明年之前对这个计划进行审查，并且会公布结果。" * 2
JAPANESE = "この町の古い橋は月曜日の会議でもう一度話し合われました。川を渡るただ一つの道であり、毎日多くの人が使っているからです。市は来年までに計画を見直すと話しています。" * 2
THAI = "สะพานเก่าของเมืองนี้ถูกพูดถึงอีกครั้งในการประชุมเมื่อวันจันทร์เพราะเป็นทางเดียวที่จะข้ามแม่น้ำและมีผู้คนจำนวนมากใช้ทุกวัน" * 2


def test_words_in_values_hide_nothing():
    assert webpages.extract(f'<article><p title="A hidden gem">{PROSE}</p></article>') == PROSE
    assert webpages.extract(f'<body><div data-id="share"><p>{PROSE}</p></div></body>') == PROSE
    assert webpages.extract(f"<div title='class=menu' data-role=nav><p>{PROSE}</p></div>") == PROSE
    assert webpages.extract(f'<p alt="display:none">{PROSE}</p>') == PROSE


def test_attributes_hide():
    for attribute in ("hidden", 'hidden=""', "HIDDEN", 'aria-hidden="true"', "aria-hidden = true", 'style="color:red; display : none"', "style='visibility:hidden'"):
        assert webpages.extract(f"<div {attribute}><p>{PROSE}</p></div><p>{PROSE} End.</p>") == PROSE + " End."
    assert webpages.extract(f'<div aria-hidden="false"><p>{PROSE}</p></div>') == PROSE


def test_an_element_that_holds_most_of_the_page_is_no_furniture():
    page = f'<div class="content side-by-side"><p>{PROSE}</p><p>{PROSE}</p><div class="share"><p>Share this page with your friends and with all of the people who you know</p></div></div><div class="sidebar"><p>{PROSE}</p></div>'
    assert webpages.extract(page) == f"{PROSE}\n{PROSE}"
    # Nested ones are asked one by one; a comment or a menu is never asked.
    assert webpages.extract(f'<div class="widget"><div class="search tags"><p>{PROSE}</p></div></div>') == PROSE
    assert webpages.extract(f'<div class="comments"><p>{PROSE}</p></div><nav><p>{PROSE}</p></nav>') == ""
    # As much text outside as inside: half is not most.
    assert webpages.extract(f'<div class="sidebar"><p>{PROSE}</p></div><div><p>{PROSE}</p></div>') == PROSE


def test_prose_in_scripts_without_spaces():
    for text in (CHINESE, JAPANESE, THAI):
        assert webpages.extract(f'<div><p>{text}</p></div><div><a href="/">首页</a> <a href="/x">新闻</a></div>') == text
    links = "".join(f'<li><a href="/{i}">相关新闻的标题在这里，点击查看更多内容</a></li>' for i in range(9))
    assert webpages.extract(f"<ul>{links}</ul>") == ""


def test_deep_nesting_is_linear():
    assert webpages.extract('<div class="side">' * 20_000 + f"<p>{PROSE}</p>") == PROSE
