import random

import numpy as np
import pytest

from gregaria.llm import stuffing
from gregaria.llm.stuffing import FEATURES, page_scores, profile, stuffed_pages

PROSE = ["The reader opens the file and checks what it holds before the cache is filled.", "If you change the port, you have to restart the server again.", "We keep the old layout so that it can be compared with the new one.", "This step was added because nobody expected the input to be empty."]
NOUNS = ["lamp", "chair", "phone", "boots", "watch", "bike"]
WORDS = ["buy", "cheap", "best", "online", "price", "sale"]


def phrases(r, n, joint):
    return joint.join(f"{r.choice(WORDS)} {r.choice(NOUNS)} {r.choice(WORDS)}" for _ in range(n))


def url(r):
    return f"https://{r.choice(WORDS)}-{r.randrange(10**6)}.test/{r.choice(NOUNS)}"


def spam(r):
    kind = r.randrange(10)
    if kind == 9:
        return phrases(r, 40, " ")
    if kind == 0:
        return phrases(r, 40, ", ")
    if kind == 1:
        return phrases(r, 40, "\n")
    if kind == 2:
        return "\n".join(url(r) for _ in range(25))
    if kind == 3:
        return "\n".join(f"* [{phrases(r, 1, '')}]({url(r)})" for _ in range(20))
    if kind == 4:
        return "/*\n" + "\n".join(f'<a href="{url(r)}">{phrases(r, 1, "")}</a>' for _ in range(20)) + "\n*/\nint main() { return 0; }"
    if kind == 5:
        return " ".join(f"#{r.choice(WORDS)}_{r.choice(NOUNS)}{r.randrange(99)}" for _ in range(40))
    if kind == 6:
        return "\n".join(f"{r.choice(NOUNS)} {r.choice(NOUNS)} red XL SKU{r.randrange(9999)} in stock {r.randrange(99)}.99" for _ in range(25))
    if kind == 7:
        return " ".join("Buy desk lamp online, desk lamp sale and desk lamp price for the best desk lamp. Looking for a desk lamp? Our desk lamp is the top desk lamp." for _ in range(6))
    return '{"name": "x", "description": "' + " ".join(f"{phrases(r, 2, ', ')} {url(r)}" for _ in range(20)) + '"}'


def sound(r):
    kind = r.randrange(9)
    if kind == 0:
        return " ".join(r.choices(PROSE, k=12))
    if kind == 1:
        return "\n".join(f"* [{r.choice(NOUNS)}]({url(r)}) - {r.choice(PROSE)} {r.choice(PROSE)}" for _ in range(15))
    if kind == 2:
        return "\n".join(f"<url><loc>https://site.test/{r.choice(NOUNS)}/{i}</loc></url>" for i in range(30))
    if kind == 3:
        return "\n".join(f'check(f{i}("{r.choice(NOUNS)} {r.choice(NOUNS)} sale sale"), {i})' for i in range(30))
    if kind == 4:
        return "\n".join(f"def f{i}(x):\n    # {r.choice(PROSE)}\n    return x + {i}" for i in range(12))
    if kind == 5:
        return "\n".join(",".join(str(r.randrange(999)) if r.random() < 0.7 else r.choice(NOUNS) for _ in range(6)) for _ in range(30))
    if kind == 6:
        return "\n".join("".join(r.choices("abcdefgh", k=7)) for _ in range(80))
    if kind == 7:
        return "\n".join(f'  "{r.choice(NOUNS)}{i}": {{"resolved": "https://registry.test/{i}.tgz", "sum": "ab{i}"}},' for i in range(25))
    return " ".join(r.choices(PROSE, k=14)) + "\n\nKeywords: " + phrases(r, 4, ", ")


def test_held_out_accuracy(spark):
    r = random.Random(11)
    rows = [(i, spam(r) if i % 12 == 0 else sound(r), ["markdown", "text", None][i % 3], "clash") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, density string")
    found = {x.doc_id for x in stuffed_pages(df).collect()}
    true = {i for i in range(900) if i % 12 == 0}
    assert len(found & true) >= 0.97 * len(true)
    assert len(found - true) <= 0.03 * len(true)


def spam_among(spark, pages, lang="text"):
    """The names of the pages that are spam, judged among sound pages of their language."""
    r = random.Random(3)
    names = list(pages)
    rows = [(i, pages[n], lang) for i, n in enumerate(names)] + [(1000 + i, sound(r), lang) for i in range(400)]
    return {names[x.doc_id] for x in stuffed_pages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect() if x.doc_id < 1000}


def test_wrappings(spark):
    r = random.Random(5)
    pages = {wrap: wrap.format(phrases(r, 60, " | ")) for wrap in ("{}", "# {}", "<html><body><p>{}</p></body></html>", '"""{}"""', "/* {} */", "﻿{}")}
    pages["languages"] = phrases(r, 60, ", ").replace("buy", "купить").replace("cheap", "便宜")
    half = " ".join(r.choices(PROSE, k=30)) + "\n\n" + phrases(r, 20, ", ")
    assert spam_among(spark, pages | {"half": half}) == set(pages)


@pytest.mark.parametrize("text", [None, "", "  \n\t", "　", "x", "<", "[", "#", "https://", "{" * 300, "a" * 200_000, "\x00" * 50])
def test_odd_texts(text):
    values = profile(text)
    assert len(values) == len(FEATURES) and values[0] < 0.5


def test_rows(spark):
    r = random.Random(2)
    page = phrases(r, 50, ", ")
    rows = [(1, page, "text"), (1, page, "text"), (None, page, None), (2, None, "text"), (3, "", None)] + [(10 + i, sound(r), "text") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert sorted((x.doc_id for x in stuffed_pages(df).collect()), key=str) == [1, 1, None]
    assert stuffed_pages(df.limit(0)).count() == 0


def test_whole_text_counts(spark):
    r = random.Random(2)
    assert spam_among(spark, {"end": " ".join(PROSE * 40) + "\n" + phrases(r, 2000, "\n")})


def test_a_language_of_mostly_spam(spark):
    r = random.Random(7)
    page = phrases(r, 50, ", ")
    copies = [(i, page, "copied") for i in range(40)] + [(100 + i, sound(r), "copied") for i in range(20)]
    varied = [(200 + i, phrases(r, 50, ", "), "varied") for i in range(40)] + [(300 + i, sound(r), "varied") for i in range(10)]
    alone = [(400 + i, spam(r), "alone") for i in range(30)]
    df = spark.createDataFrame(copies + varied + alone, "doc_id bigint, text string, lang string")
    assert {x.doc_id for x in stuffed_pages(df).collect()} == {*range(40), *range(200, 240), *range(400, 430)}


def test_numbered_lists_and_hashtags_with_signs(spark):
    r = random.Random(9)
    pages = {joint: "\n".join(f"{i}{joint}{phrases(r, 1, '')}" for i in range(1, 41)) for joint in (") ", ". ")}
    tags = ["#{}(new)", "#{}=sale", "#only${}", "#{}^2"]
    pages["tags"] = "\n".join(" ".join(r.choice(tags).format(r.choice(NOUNS)) for _ in range(5)) for _ in range(10))
    assert spam_among(spark, pages) == set(pages)


def test_keywords_in_code_and_data(spark):
    r = random.Random(13)
    goods = "\n".join(f"{r.choice(NOUNS)} {r.choice(NOUNS)} red XL ${r.randrange(99)}.99" for _ in range(25))
    pages = {
        "price": goods,
        "yaml": "\n".join(f"keywords: {phrases(r, 6, ', ')}" for _ in range(8)),
        "pretty": "{\n" + "\n".join(f'  "field{i}": "{phrases(r, 6, ", ")}",' for i in range(8)) + "\n}",
        "array": "[\n" + "\n".join(f'  "{phrases(r, 1, "")}",' for i in range(40)) + "\n]",
        "short": "\n".join(f'{{"tags": "{phrases(r, 6, ", ")}"}}' for _ in range(8)),
        "mark": "\ufeff" + '{"name": "x", "description": "' + phrases(r, 40, ", ") + '"}',
        "assigned": "\n".join(f'kw = "buy {n}, cheap {n}"' for n in NOUNS * 3),
        "underscored": "\n".join(phrases(r, 5, ", ").replace(" ", "_").replace(",_", ", ") for _ in range(8)),
        "bare": "\n".join(f"www.{r.choice(WORDS)}-{i}.example" for i in range(30)),
        "bracket": "\n".join(phrases(r, 8, ", ") + " [new]" for _ in range(8)),
    }
    assert set(pages) - spam_among(spark, pages) == set()


def test_data_and_code_stay_sound(spark):
    r = random.Random(17)
    pages = {
        "locale": "\n".join(f'  "{r.choice(NOUNS)}_{i}": "{phrases(r, 1, "")}",' for i in range(40)),
        "records": "\n".join(f'{{"id": {i}, "item": "{r.choice(NOUNS)}", "stock": {r.randrange(99)}, "code": "a{i}"}}' for i in range(40)),
        "sums": "\n".join(f'    "integrity": "sum-{r.getrandbits(160):040x}",' for _ in range(40)),
        "checks": "\n".join(f'check(f{i}("{phrases(r, 3, " ")}"), {i})' for i in range(40)),
        "calls": "\n".join(f'run("{r.choice(NOUNS)} {r.choice(WORDS)}", x{i}, {{ deep: true }})' for i in range(40)),
        "yaml": "\n".join(f'{r.choice(NOUNS)}:\n  size: {i}.99\n  state: "{r.choice(WORDS)} {r.choice(NOUNS)}"' for i in range(30)),
        "modules": "\n".join(f"mod {r.choice(NOUNS)};" for _ in range(40)),
        "php": "\n".join(f"${r.choice(NOUNS)}_{i} = {i}.99" for i in range(30)),
    }
    assert spam_among(spark, pages) == set()


def test_links_to_one_host(spark):
    r = random.Random(19)
    shop = lambda: f"https://shop.test/{phrases(r, 1, '').replace(' ', '-')}-{r.randrange(999)}"
    spam_pages = {
        "shop": "\n".join(shop() for _ in range(30)),
        "named": "\n".join(f"* [{phrases(r, 1, '')}](https://shop.test/p/{i})" for i in range(30)),
        "most": "\n".join(f"https://shop.test/p/{i}" if i % 20 < 7 else url(r) for i in range(60)),
        "one host": "\n".join(f"https://shop.test/{i}" for i in range(60)),
        "nine hosts": "\n".join(f"https://shop{i % 9}.test/{i}" for i in range(60)),
    }
    names = "install upgrade logging metrics storage network backup restore tuning security users roles events queues caches drivers".split()
    sound_pages = {
        "guides": "\n".join(f"* [{p} guide](https://project.test/docs/{p}-guide.html)" for p in names),
        "bare": "\n".join(f"https://project.test/docs/{p}" for p in names),
        "map": "\n".join(f"<url><loc>{shop()}</loc></url>" for _ in range(30)),
        "lock": "\n".join(f'  resolved "https://registry.test/{n}-{w}-{n}.tgz"' for n in NOUNS for w in WORDS),
    }
    assert spam_among(spark, spam_pages | sound_pages) == set(spam_pages)


def test_short_lines_of_data_and_code(spark):
    r = random.Random(29)
    pages = {f"json {k}": "\n".join(f'{{"tags": "{phrases(r, k, ", ")}"}}' for _ in range(12)) for k in (4, 8, 12)}
    pages["assigned"] = "\n".join(f"k={r.choice(WORDS)} {r.choice(NOUNS)}" for _ in range(60))
    pages["joined"] = "\n".join(f"{r.choice(WORDS)}_{r.choice(WORDS)}_{r.choice(NOUNS)}" for _ in range(60))
    assert set(pages) - spam_among(spark, pages) == set()


def test_scripts_without_spaces(spark):
    r = random.Random(23)
    lists = [("购买 便宜 最好 网上 价格 打折", "台灯 椅子 手机 靴子 手表"), ("激安 最安値 通販 人気 おすすめ", "ランプ 椅子 スマホ ブーツ 腕時計"), ("ซื้อ ราคาถูก โปรโมชั่น", "โคมไฟ เก้าอี้ มือถือ")]
    pages, sound_pages = {}, {}
    for before, goods in lists:
        for joint in ("、", " ", "，", "\n"):
            page = joint.join(r.choice(before.split()) + r.choice(goods.split()) + r.choice(before.split()) for _ in range(60))
            pages[f"{goods[:4]} {joint}"] = page
    sentences = ["读取文件并检查其中的内容", "如果你修改了端口就需要重新启动服务器", "我们保留旧的布局是为了能和新的比较", "这一步的输入有时是空的"]
    sound_pages["sentences"] = "\n".join(r.choice(sentences) for _ in range(40))
    thai = ["โปรแกรมนี้อ่านแฟ้มและตรวจสอบข้อมูลที่อยู่ในนั้น", "ค่าของพอร์ตจะได้รับการตรวจสอบ", "ไม่ต้องตั้งค่าใหม่ในครั้งต่อไป"]
    sound_pages["thai"] = "\n".join(r.choice(thai) for _ in range(40))
    places = "北京、上海、广州、深圳、成都、杭州、重庆、武汉、西安、苏州、天津、南京、长沙、郑州、东莞、青岛、沈阳、宁波、昆明、大连"
    sound_pages |= {"places": places, "place lines": places.replace("、", "\n")}
    sound_pages["titles"] = ("\n".join(["安装说明", "配置文件", "命令参考", "日志格式", "常见问题", "升级步骤", "网络设置", "备份恢复", "性能调优", "安全策略"]))
    assert spam_among(spark, pages | sound_pages) == set(pages)


def test_each_gate_counts(spark):
    """Pages off in another direction are kept by the direction alone, pages near the norm by the distance alone."""
    r = random.Random(31)
    rows = [(i, sound(r), "text") for i in range(300)] + [(1000 + i, spam(r), "text") for i in range(20)] + [(2000 + i, "\n".join(f"x{j} = f({j}, y[{i}]);" for j in range(40)), "prose") for i in range(5)]
    rows += [(3000 + i, " ".join(r.choices(PROSE, k=12)), "prose") for i in range(200)]
    scores = page_scores(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    assert len(scores) == len(rows)
    far = {x.doc_id for x in scores if x.distance > stuffing.MIN_DISTANCE}
    towards = {x.doc_id for x in scores if x.direction > stuffing.MIN_DIRECTION}
    assert far - towards and towards - far and {*range(1000, 1020)} <= far & towards


def test_scores_as_by_plain_arrays(spark):
    """Medians, scales, correlation, distance and direction worked out again with arrays."""
    r = random.Random(37)
    rows = [(i, (spam if i % 9 == 0 else sound)(r), ["a", "b", "", None][i % 4]) for i in range(240)]
    rows += [(1000 + i, *rows[9][1:]) for i in range(30)]
    found = {x.doc_id: x for x in page_scores(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    values = {i: np.array(profile(t)) for i, t, _ in rows}
    middle = lambda a: np.sort(a, 0)[(len(a) + 1) // 2 - 1]
    distinct = {(lang, t): values[i] for i, t, lang in rows}
    whole = middle(np.array(list(distinct.values())))
    low, high = np.array(stuffing.CENTRE_BOUNDS).T
    for lang in ("a", "b", "", None):
        own = np.array([v for (x, _), v in distinct.items() if x == lang])
        n, prior = len(own), stuffing.PRIOR_TEXTS
        centre = np.clip((middle(own) * n + whole * prior) / (n + prior), low, high)
        least = np.array(stuffing.SCALES)
        scale = np.clip(1.4826 * middle(abs(own - centre)), least, stuffing.SCALE_RANGE * least)
        cut = np.clip((own - centre) / scale, -3, 3)
        products = cut.T @ cut / n
        wide = np.sqrt(np.maximum(np.diag(products), 1e-9))
        inverse = np.linalg.inv((1 - stuffing.SHRINK) * products / np.outer(wide, wide) + stuffing.SHRINK * np.eye(len(least)))
        for i in (i for i, _, x in rows if x == lang):
            z = (values[i] - centre) / scale
            assert found[i].distance == pytest.approx(np.sqrt(z @ inverse @ z), abs=1e-6)
            assert found[i].direction == pytest.approx(z @ stuffing.SPAM_DIRECTION / np.sqrt(len(z)) / max(np.linalg.norm(z), 1e-6), abs=1e-6)


def test_many_languages(spark, monkeypatch):
    r = random.Random(41)
    df = spark.createDataFrame([(i, (spam if i % 9 == 0 else sound)(r), f"l{i % 3 * (i % 7)}") for i in range(300)], "doc_id bigint, text string, lang string").cache()
    by_broadcast = {tuple(x) for x in stuffed_pages(df).collect()}
    monkeypatch.setattr(stuffing, "BROADCAST_LANGUAGES", 0)
    assert {tuple(x) for x in stuffed_pages(df).collect()} == by_broadcast != set()
