"""Rule classifiers of the intake: ordered decisions over folded text.

Every marker set is a parameter; the defaults are the fixed values of the rules.
Gates only read columns, so one projection classifies a row. ``gate`` composes
them in their fixed precedence.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as x

# ---------------------------------------------------------------- boilerplate

#: Shapes of paragraphs that are never prose, whatever their length.
LONG_BOILERPLATE = [
    r"^saiba\s+mais\s+sobre\b",
    r"^para\s+ver\s+mais\s+novidades\b",
    r"^узнать\s+больше\s+о\b",
    r"^clique\s+(aqui|neste\s+link|no\s+link)\b",
    r"^кликай(те)?\s+(по|на|сюда)\b",
    # a shop's name with a selling verb; its name alone may be news
    r"^n?a\s+universo\s+hot\s+wheels\b[^.]{0,80}\b(voc[eê]\s+(encontra|acha|vai\s+encontrar)|encontre)",
    r"^a\s+universo\s+hot\s+wheels\s+[eé]\s+a\s+maior\s+loja\b",
    r"^\*{0,2}в\s+\*{0,2}universo\s+hot\s+wheels\b[^.]{0,80}\bнайд[её]те",
    r"^\*{0,2}universo\s+hot\s+wheels\*{0,2}\s*[—–-]\s*крупнейш",
    r"\bredirecionador(?:es)?\s+de\s+encomendas\b",
    r"\bперенаправлени\w{0,3}\s+посылок\b",
]
#: The same for paragraphs of at most 120 characters.
_PLATFORMS = "instagram|twitter|x|tiktok|youtube|facebook|reddit|patreon|discord|linktree"
SHORT_BOILERPLATE = [
    r"^share\s+(on|via|to)\s+(facebook|twitter|x|linkedin|pinterest|whatsapp|telegram|email|reddit)\b",
    r"^(tweet|pin it|pin on pinterest)$",
    r"^email this( article)?$",
    r"^copy (link|url|article url)$",
    r"^subscribe( to (our )?newsletter)?$",
    r"^(related (articles?|posts?)|see also|you may also like)$",
    r"^read more[:\s]*$",
    r"^(tags?|filed under|categories?):",
    r"^comments?$",
    rf"^(follow|check|subscribe\s+to)\s+(me|us)\s+on\s+({_PLATFORMS})\b",
    rf"^\(\s*(follow|check|subscribe\s+to|join)\s+(me|us)\s+on\s+({_PLATFORMS})\s+@\w{{2,30}}\s*\)$",
    rf"^({_PLATFORMS})\s*:\s*@?[\w./_-]+\s*$",
    r"^@\w{2,30}$",
    r"^subscribe\s+to\s+my\s+(channel|newsletter|patreon|youtube|page|feed)\b",
    r"^\s*\*?quick\s+link[!:]",
    r"^buy\s+(now\s+)?from\s+\S",
    r"^\s*\*?find\b.*\b(on|at)\s+(ebay|amazon|aliexpress|mattel|walmart)\b",
    r"^поделит(ь(ся)?|есь)\s+(на|в|через)\s+(facebook|twitter|x|вконтакте|whatsapp|telegram|email)\b",
    r"^твитнуть$",
    r"^подписать(ся|есь)( на (нашу )?рассылку)?$",
    r"^(читайте|смотрите) (также|далее)$",
    r"^(тэги|теги|категории|метки):",
    r"^комментари(и|й)$",
    r"^\s*\*?быстр(ая|ой)\s+ссылк(а|у|и)[!:]",
    r"^\s*(найти|купить)\b.*\bна\s+(ebay|amazon|aliexpress|mattel|walmart)\b",
    r"^compartilhar\s+(no|em|via|por)\s+(facebook|twitter|x|whatsapp|telegram|email)\b",
    r"^marcadores\s*:",
    r"^postado\s+por\b",
    r"^postagem$",
    r"^enviar\s+por\s+email\b",
    r"^postagens\s+mais\s+(antigas|recentes)$",
    r"^assinar\s*:",
    r"^leia\s+mais$",
    r"^postar\s+(um\s+)?coment[áa]rio$",
    r"^p[aá]gina\s+(inicial|principal)$",
]


def boilerplate(paragraph: Column, long: list[str] = LONG_BOILERPLATE, short: list[str] = SHORT_BOILERPLATE, limit: int = 120) -> Column:
    """Whether a paragraph is an interface label or an outro; null and empty are not."""
    p = F.regexp_replace(paragraph, r"(?U)^\s+|\s+$", "")

    def any_of(patterns: list[str]) -> Column:
        out = F.lit(False)
        for pattern in patterns:
            out = out | p.rlike("(?iuU)" + pattern)
        return out

    return F.coalesce((p != "") & (any_of(long) | ((F.char_length(p) <= limit) & any_of(short))), F.lit(False))


def without_boilerplate(paragraphs: Column, **options) -> Column:
    """The paragraphs that are not boilerplate, in order."""
    return F.filter(paragraphs, lambda p: ~boilerplate(p, **options))


def blocks_without_boilerplate(blocks: Column, **options) -> Column:
    """Content blocks without boilerplate: by text if there is one, else by caption."""
    return F.filter(blocks, lambda b: ~F.when(F.coalesce(b["text"], F.lit("")) != "", boilerplate(b["text"], **options)).otherwise(boilerplate(b["caption"], **options)))


# ---------------------------------------------------------------- relevance


@dataclass(frozen=True)
class Relevance:
    """Fixed values of the relevance decision."""

    title_terms: tuple[str, ...] = ("hot wheels", "hotwheels")
    sibling_labels: tuple[str, ...] = (
        "matchbox", "maisto", "tomica", "johnny lightning", "tarmac works", "m2 machines", "mini gt", "auto world", "majorette",
        "greenlight", "kaido house",
    )
    series_labels: tuple[str, ...] = (
        "silver series", "pop culture", "car culture", "team transport", "boulevard", "neon speeder", "neon speeders", "rlc",
        "red line club", "trackin trucks", "track fleet",
    )
    sibling_title: tuple[str, ...] = ("matchbox",)
    series_title: tuple[str, ...] = ("silver series", "pop culture", "neon speeder", "car culture", "team transport", "boulevard", "red line club")
    broad_hosts: tuple[str, ...] = ()


def _contains_any(column: Column, terms: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for term in terms:
        out = out | F.contains(column, F.lit(term))
    return out


def relevant(title: Column, labels: Column, link: Column, rules: Relevance = Relevance()) -> Column:
    """The six-step decision, most authoritative evidence first; nothing to inspect keeps."""
    name = F.lower(F.coalesce(title, F.lit("")))
    own = F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda s: F.lower(F.trim(s)))
    overlap = lambda words: F.coalesce(F.arrays_overlap(own, F.array(*map(F.lit, words)).cast("array<string>")), F.lit(False))
    return (
        F.when((name == "") & (F.size(own) == 0), F.lit(True))
        .when(_contains_any(name, rules.title_terms), F.lit(True))
        .when(overlap(rules.sibling_labels), F.lit(False))
        .when(overlap(rules.series_labels), F.lit(True))
        .when(_contains_any(name, rules.sibling_title), F.lit(False))
        .when(_contains_any(name, rules.series_title), F.lit(True))
        .when(_contains_any(F.lower(F.coalesce(link, F.lit(""))), rules.broad_hosts), F.lit(False))
        .otherwise(F.lit(True))
    )


def text_only_checklist(link: Column, title: Column, paragraphs: Column, floor: int = 500) -> Column:
    """A checklist by its URL, or by its title with a body strictly under the floor."""
    by_url = F.coalesce(link.rlike("(?i)case-contents-checklist"), F.lit(False))
    by_title = F.coalesce(title.rlike(r"(?iU)\bcheck[\s-]?list\b"), F.lit(False))
    return by_url | (by_title & (x.total_length(paragraphs) < floor))


# ---------------------------------------------------------------- promotion


@dataclass(frozen=True)
class Promo:
    """Fixed values of the promotion gate: calls to act, offers, the seller's voice, and words that never decide."""

    direct: tuple[str, ...] = ("compre já", "garanta o seu", "garanta já", "não perca", "aproveite a oferta", "shop now", "buy now", "use code", "order yours")
    offer: tuple[str, ...] = ("cupom", "código de desconto", "frete grátis", "promoção", "coupon code", "discount code", "free shipping")
    seller: tuple[str, ...] = ("nossa loja", "em nossa loja", "our store", "our shop")
    weak: tuple[str, ...] = ("loja", "à venda", "estoque", "desconto", "oferta", "store", "on sale", "in stock", "discount", "offer")
    url_tokens: tuple[str, ...] = ("loja", "shop", "store")
    max_paragraphs: int = 8
    max_chars: int = 2000


def hits(folded: Column, markers: tuple[str, ...]) -> Column:
    """The markers that occur as whole words in a folded text, in the order they are declared."""
    known = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(x.fold_literal(m)).alias("f")) for m in markers])
    return F.transform(F.filter(known, lambda k: F.contains(folded, k["f"])), lambda k: k["m"])


def promo_input(title: Column, article_title: Column, paragraphs: Column, rules: Promo = Promo()) -> Column:
    """What the promotion gate reads: the title and the clipped start of the body."""
    head = x.text_or(x.scan_input(title, rules.max_chars), x.scan_input(article_title, rules.max_chars))
    body = F.array_join(F.slice(F.coalesce(paragraphs, F.array().cast("array<string>")), 1, rules.max_paragraphs), " ")
    return F.concat(head, F.lit(" "), F.substring(body, 1, rules.max_chars))


def promo_markers(folded: Column, folded_path: Column, rules: Promo = Promo()) -> Column:
    """All matched markers if the text tells the reader to buy, else an empty array.

    Weak words inside a strong marker's span do not count: strong spans are blanked first.
    """
    strong = rules.direct + rules.offer + rules.seller
    residual = folded
    for m in strong:
        residual = F.replace(residual, F.lit(x.fold_literal(m)), F.lit(" "))
    direct, offer, seller = (hits(folded, m) for m in (rules.direct, rules.offer, rules.seller))
    tokens = F.transform(hits(folded_path, rules.url_tokens), lambda t: F.concat(F.lit("url:"), t))
    calls = F.size(direct) + F.size(offer)
    is_promo = ((F.size(seller) > 0) & ((F.size(direct) > 0) | (calls >= 2))) | (calls >= 3)
    found = F.concat(hits(folded, strong), hits(residual, rules.weak), tokens)
    return F.when(is_promo, found).otherwise(F.array().cast("array<string>"))


# ---------------------------------------------------------------- subject gates


@dataclass(frozen=True)
class Subjects:
    """Fixed values of the hold and genre gates."""

    hold: tuple[str, ...] = (
        "poster", "posters", "pôsteres", "cartaz", "cartazes", "catálogo", "catálogos", "catalog", "catalogs", "catalogue", "catalogues",
        "embalagem", "embalagens", "packaging", "cartela", "cartelas", "blister", "blisters", "cardback", "cardbacks", "card back",
        "card art", "box art",
    )
    video: tuple[str, ...] = ("vídeo", "vídeos", "unboxing", "assista", "assistam", "youtube")
    lead_only: tuple[str, ...] = ("watch",)
    review: tuple[str, ...] = (
        "review", "reviews", "full case", "assortment", "we open", "análise", "análises", "abrimos", "caixa completa", "caixa fechada",
        "lote completo",
    )
    verbs: tuple[str, ...] = (
        "leaked", "leaks", "surfaces", "surfaced", "goes", "went", "breaks", "broke", "shows", "showed", "confirms", "confirmed", "debuts",
        "debuted", "arrives", "arrived", "reveals", "revealed", "appears", "appeared", "hits", "drops", "dropped", "lands", "landed",
        "returns", "returned", "gets", "got", "becomes", "became", "is", "are", "was", "were", "has", "have", "wins", "won", "revela",
        "revelou", "revelado", "vaza", "vazou", "aparece", "apareceu", "mostra", "mostrou", "confirma", "confirmou", "chega", "chegou",
        "ganha", "ganhou", "traz", "trouxe", "volta", "voltou", "saiu", "virou",
    )
    heads: tuple[str, ...] = (
        "the", "a", "an", "this", "these", "that", "those", "all", "every", "my", "our", "of", "with", "o", "os", "as", "um", "uma", "uns",
        "umas", "do", "da", "dos", "das", "de", "no", "na", "nos", "nas", "ao", "aos", "com", "todo", "toda", "todos", "todas", "este",
        "esta", "esse", "essa",
    )
    event: tuple[str, ...] = (
        "convention", "conventions", "convenção", "convenções", "expo", "feira", "feiras", "encontro", "encontros", "meetup", "nationals",
        "swap meet", "legends tour",
    )
    organisation: tuple[str, ...] = (
        "datas", "ingresso", "ingressos", "inscrições", "inscrição", "programação", "credenciamento", "acontece", "dates", "tickets",
        "registration", "will be held", "schedule", "venue",
    )
    actions: dict = field(default_factory=lambda: {"video_lead": "drop", "video_np": "hold", "video_signals": "hold", "event": "drop"})


def subject_hits(title: Column, path: Column, markers: tuple[str, ...]) -> Column:
    """Markers in the folded title, then those only in the folded URL path, as url:marker."""
    of_title = hits(title, markers)
    of_path = F.array_except(hits(path, markers), of_title)
    return F.concat(of_title, F.transform(of_path, lambda m: F.concat(F.lit("url:"), m)))


def hold_markers(title: Column, path: Column, rules: Subjects = Subjects()) -> Column:
    return subject_hits(title, path, rules.hold)


def _lead_pattern(markers: tuple[str, ...]) -> str:
    plain = sorted({x.fold_literal(m).strip() for m in markers}, key=len, reverse=True)
    return "|".join(p.replace(" ", r"\s+") for p in plain)


def genre(plain_title: Column, title: Column, path: Column, rules: Subjects = Subjects()) -> Column:
    """struct(genre, branch, action, markers) of a deaccented title, folded title and folded path; nulls to keep.

    Branches in order: a leading video word with a separator; one that heads a noun
    phrase in a title without a headline verb; video words with a second signal; an
    event's name with an organisational word.
    """
    lead = F.regexp_extract(plain_title, rf"^\s*({_lead_pattern(rules.video + rules.lead_only)})\s*[:\-–—]", 1)
    phrase = F.regexp_extract(plain_title, rf"^\s*({_lead_pattern(rules.video)})\s+(?:{'|'.join(rules.heads)})\b", 1)
    video, review = subject_hits(title, path, rules.video), subject_hits(title, path, rules.review)
    names, organisation = subject_hits(title, path, rules.event), subject_hits(title, path, rules.organisation)
    clause = F.size(hits(title, rules.verbs)) > 0
    branch = (
        F.when(lead != "", F.lit("video_lead"))
        .when((phrase != "") & ~clause, F.lit("video_np"))
        .when((F.size(video) > 0) & ((F.size(review) > 0) | (F.size(video) >= 2)), F.lit("video_signals"))
        .when((F.size(names) > 0) & (F.size(organisation) > 0), F.lit("event"))
    )
    action = F.create_map(*[F.lit(v) for kv in rules.actions.items() for v in kv])
    word = F.when(branch == "video_lead", F.array(F.concat(lead, F.lit(":")))).when(branch == "video_np", F.array(F.concat(phrase, F.lit(" …")))).otherwise(F.array().cast("array<string>"))
    markers = F.when(branch == "event", F.concat(names, organisation)).when(branch.isNotNull(), F.concat(word, video, review))
    return F.struct(
        F.when(branch == "event", F.lit("event")).when(branch.isNotNull(), F.lit("video")).alias("genre"),
        branch.alias("branch"),
        F.when(branch.isNotNull(), action[branch]).alias("action"),
        F.coalesce(markers, F.array().cast("array<string>")).alias("markers"),
    )


# ---------------------------------------------------------------- precedence


def with_folds(articles: DataFrame, promo: Promo = Promo()) -> DataFrame:
    """The columns that the gates read; folding runs once per row, before any decision."""
    path = F.coalesce(F.try_parse_url(F.col("url"), F.lit("PATH")), F.lit(""))
    title = x.scan_input(F.col("title"), promo.max_chars)
    return articles.withColumns(
        {
            "__plain": x.deaccented(title),
            "__path": x.deaccented(x.scan_input(path, promo.max_chars)),
            "__promo": x.deaccented(promo_input(F.col("title"), F.lit(None).cast("string"), F.col("paragraphs"), promo)),
        }
    ).withColumns({"__title": x.tokens_of(F.col("__plain")), "__path": x.tokens_of(F.col("__path")), "__promo": x.tokens_of(F.col("__promo"))})


def gate(articles: DataFrame, promo: Promo = Promo(), subjects: Subjects = Subjects(), floor: int = 500) -> DataFrame:
    """Articles (url, title, paragraphs, …) with outcome, markers and branch; paragraphs null means no article.

    Precedence: no article, checklist, promotion, hold, genre; a held subject is not tested for genre.
    """
    df = with_folds(articles, promo)
    title, path = F.col("__title"), F.col("__path")
    df = df.withColumns(
        {"__p": promo_markers(F.col("__promo"), path, promo), "__h": hold_markers(title, path, subjects), "__g": genre(F.col("__plain"), title, path, subjects)}
    )
    outcome = (
        F.when(F.col("paragraphs").isNull(), F.lit("no_article"))
        .when(text_only_checklist(F.col("url"), F.col("title"), F.col("paragraphs"), floor), F.lit("checklist"))
        .when(F.size("__p") > 0, F.lit("promo"))
        .when(F.size("__h") > 0, F.lit("held_for_review"))
        .when(F.col("__g.action") == "drop", F.lit("genre"))
        .when(F.col("__g.action") == "hold", F.lit("held_for_review"))
        .otherwise(F.lit("staged"))
    )
    markers = F.when(F.col("outcome") == "promo", F.col("__p")).when((F.col("outcome") == "held_for_review") & (F.size("__h") > 0), F.col("__h")).when(
        F.col("outcome").isin("genre", "held_for_review"), F.col("__g.markers")
    )
    branch = F.when(F.col("outcome").isin("genre", "held_for_review") & (F.size("__h") == 0), F.col("__g.branch"))
    out = df.withColumn("outcome", outcome).withColumn("markers", F.coalesce(markers, F.array().cast("array<string>"))).withColumn("branch", branch)
    return out.drop("__plain", "__path", "__promo", "__title", "__p", "__h", "__g")


# ---------------------------------------------------------------- plugs inside prose

#: Where a sentence begins and ends, and the sentences inside prose that only advertise or point elsewhere.
_START, _END = r"(?iU)(?:(?<=[.!?])\s*|^)", r"[^.!?]*?(?:[.!?]+|$)\s*"
PLUG_PATTERNS = [
    rf"{_START}\*{{0,2}}(?:нажми(?:те)?|кликни(?:те)?|жми(?:те)?)\s*\*{{0,2}}\s*(?:сюда|здесь|по\s+ссылке){_END}",
    rf"{_START}[^.!?]{{0,120}}?(?:посмотр|увид|прочит|показыва|публикова|постил)[^.!?]{{0,120}}?по\s+\*{{0,2}}(?:этой\s+)?ссылке\*{{0,2}}{_END}",
    rf"{_START}[^.!?]{{0,120}}?(?:в|на)\s+\*{{0,2}}(?:видео|фото|картинке|изображении)\*{{0,2}}\s+(?:ниже|выше){_END}",
    rf"{_START}[^.!?]{{0,120}}?(?:рекомендуем|советуем|recomendamos|sugerimos|indicamos|we\s+recommend)(?:[^.]|\.(?=\S)){{0,120}}?(?<![\w-])(?:{_PLATFORMS})\.com/\S*\s*",
    rf"(?iU)\s*\(\s*[^()]*?(?:{_PLATFORMS})\s*@\w{{2,30}}[^()]*?\)\s*",
    rf"{_START}[^.!?]*?(?:подпиш[иу]тесь|подпис[ыа]вайтесь|подписаться|следите\s+за\s+(?:нами|мной)|(?:мой|наш|моего|нашего)\s+(?:{_PLATFORMS}))"
    rf"[^.!?]*?(?:на\s+(?:меня|нас)|за\s+(?:нами|мной)|(?:{_PLATFORMS})){_END}",
    rf"{_START}[^.!?]*?(?:follow|check|subscribe\s+to)\s+(?:me|us)\s+on\s+(?:{_PLATFORMS}){_END}",
]


def without_plugs(column: Column, patterns: list[str] = PLUG_PATTERNS) -> Column:
    return x.stripped(column, patterns)


def blocks_without_plugs(blocks: Column, patterns: list[str] = PLUG_PATTERNS) -> Column:
    """Blocks (with fields type, text, caption) without plugs; prose blocks that are left empty go, others stay."""
    clean = F.transform(blocks, lambda b: b.withField("text", without_plugs(b["text"], patterns)).withField("caption", without_plugs(b["caption"], patterns)))
    return F.filter(clean, lambda b: ~F.coalesce(b["type"].isin("paragraph", "lead", "heading") & (b["text"] == ""), F.lit(False)))
