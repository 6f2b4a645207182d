"""Wording of template residue: slot notations, filler, error pages and notices that scripts are needed, and what marks a report about them."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from re import _constants as C
from re import _parser as parser

import ahocorasick

from tracewell.llm import residue_concepts as concepts

_ = re.IGNORECASE

# Wording by kind, in the languages of the corpus.

#: Notations of unfilled slots; those that other texts use too are judged by their content below.
SLOTS = re.compile(
    r"""\{\{\{?[^{}\n]*\}?\}\}                # {{name}} {{{name}}} {{name|default}}
    | \{[%!][^{}\n]+\}                         # {% name %} {!name}
    | \#\{[^{}\n]+\} | @\{[^{}\n]+\} | \$\{[^{}\n]+\} | \$\[[^\[\]\n]+\]
    | (?<![\])}])\{[A-Za-z][\w. ]*\} | (?<![\])}])\{\d{1,2}\}(?!\w)
    | @@[A-Za-z][\w.]*@@ | \*\|[A-Za-z][\w.: ]*\|\* | \[\[[A-Za-z][\w. ]*\]\] | %%[A-Za-z][\w.]*%%
    | <%[=-]?[^<>%\n]+%> | <<[A-Za-z][\w. ]*>> | &lt;[A-Za-z][\w. ]*&gt;
    | (?<![\w%])%[A-Za-z][A-Za-z_.]+%(?![\w%]) | %\([A-Za-z][\w. ]*\)[sdf] | (?<![\w%])%(?:\d\$)?[sd](?![\w%])
    | (?<![\w:/]):[A-Za-z][A-Za-z_.]+:(?![\w:/]) | (?<!~)~[A-Za-z][A-Za-z_.]+~(?![\w~]) | (?<!\w)__[A-Za-z][A-Za-z_.]+__(?!\w)
    | \[(?:\.{3,}|\s*_*\s*|…+)\] | _{4,}
    | \[object\ Object\] | (?<![\w])X{3,}(?:-X{3,})+(?![\w])
    | \[[^\[\]\n]{2,}\] | (?<![<\w])<[^<>\n|]{2,}>(?!>) | \((?:fill\ in|fill\ out|insert|enter|add|your|complete|tbd|todo)\b[^()\n]*\)""",
    re.VERBOSE | _,
)
#: What any slot holds, for a quick look.
HINT = re.compile(r"\{(?!\s?\")|\[(?!-|\d+\]|\")|<(?!/?(?:html|head|title|body|h\d|p|hr|noscript)\b(?! \w))|[$~]|__|@@|\*\||%[a-z(\d%]|&lt;|:[a-z][a-z_.]+:|\((?:fill|insert|enter|add|your|complete|tbd|todo)|xxx-", _)
#: Content that makes brackets a slot: what to do, in any of the languages.
FILL = re.compile(
    r"^(?:insert|enter|fill|add|your|todo|tbd|tba|choose|select|type|put)\b|\bto be (?:added|filled|completed|confirmed|defined)\b|\b(?:here|aquí|aqui|ici|hier)\b$|^name of\b|^(?:saisir|indiquer|insérer|compléter|ajouter|votre)\b|\bà (?:compléter|remplir|saisir|ajouter|insérer)$"
    r"|\b(?:einfügen|eintragen|ergänzen|einsetzen|ausfüllen|eingeben)$|^(?:bitte|hier|ihr|ihre)\b|^(?:indique|indicar|insertar|introduzca|introducir|escriba|añadir|rellenar|completar|su)\b|\b(?:por|a|para) (?:completar|rellenar|definir|preencher|confirmar)$|^(?:inserir|informar|informe|preencher|digite|indicar|seu|sua)\b"
    r"|^(?:укажите|вставить|вставьте|введите|впишите)\b|\b(?:указать|вставить|вписать|заполнить)$|を?(?:入力|記入|挿入)|(?:दर्ज|भरें|डालें|लिखें)",
    _,
)
#: Names of fields of the domain's forms.
FIELDS = frozenset("date reviewer analyst amount unit country ip txid tier reference reason score recipient exchange period summary address hop_count first_seen case_id entity_name total_btc case entity hop name number".split())
#: Words in brackets or angles that are no slots.
NO_SLOT = frozenset("redacted unknown sic none null script noscript html head body title h1 h2 p hr br div span a b i anonymous omitted removed deleted ul ol li table tr td th tbody thead img code pre em strong u s sub sup form input button label section article nav header footer main meta link style svg n nil eof".split())
#: Content of code and of other sentences about notation.
ABOUT = re.compile(
    r"^\W*usage:|\s--[a-z]|\bmerge fields?\b|\bcolumn names?\b|\bexport path\b|\bthe pattern\b|\bquery such as\b|\blog format\b|\bstands? for\b|\brenames?\b|\bpatch \(|\bscreen names?\b|\bplaceholders? (?:in|of|for|such)\b|\bvariables?\b|\bsyntax\b|\bregex\b|\bescaped?\b|\bis written as\b|\bcalled\b|\$\{(?:HOME|PATH|USER|PWD)\}|\]\{\d",
    _,
)
QUOTED = re.compile(r"\"[^\"\n]{1,80}\"|“[^”\n]{1,80}”|„[^“”\n]{1,80}[“”]|«[^»\n]{1,80}»|`[^`\n]{1,80}`")
#: A report: it dates, cites or places what it says.
REPORT = re.compile(r"\bcf-\d|\b\d{4}-\d\d-\d\d\b|\b\d{1,2}\.\d\d\.\d{4}\b|\b\d{1,2} (?:january|february|march|april|may|june|july|august|september|october|november|december)\b|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b[0-9a-f]{8,}\b|\b(?:bc1|[13])[0-9A-Za-z]{5,}(?:…|\.{3})?|⟨(?:date|ip|ref|hex|addr)⟩|\bsensors?\b", _)

SCRIPT = r"(?:java ?scripts?|js|scripts?|scripting|script support|active content)"
NOTICE = re.compile(
    rf"\b(?:enable|activate|allow|turn on|switch on|unblock|permit) (?:the use of )?{SCRIPT}\b"
    rf"|\b{SCRIPT} (?:support )?(?:is|are|has|have|must|needs?|seems?|appears?)\b.{{0,40}}\b(?:disabled|off|blocked|required|needed|turned on|switched on|enabled|unavailable|inactive)\b"
    rf"|\b(?:needs?|requires?|without|uses?|relies on) {SCRIPT}\b|\b{SCRIPT} (?:is )?required\b|\bscript-capable\b|\bnoscript mode\b|\b(?:does not|doesn.t|do not|don.t|cannot|can.t) (?:run|support|execute) {SCRIPT}\b"
    r"|\bchecking your browser\b|\bverify(?:ing)? (?:that )?you are (?:a )?human\b|\bhow to allow scripts\b|\benable cookies\b|\bcookies (?:are|must be) (?:disabled|enabled)\b"
    r"|\bjavascript\b.{0,40}\b(?:aktivieren|einschalten|zulassen|erlauben)\b|\b(?:aktivieren|schalten|erlauben) sie (?:bitte )?(?:javascript|skripte)\b|\b(?:benötigt|braucht|erfordert) (?:javascript|skripte)\b|\bohne (?:javascript|skripte)\b"
    r"|\bactiv[ae] (?:el )?javascript\b|\bhabilite (?:el |o )?javascript\b|\bnecesita (?:javascript|scripts)\b|\brequiere (?:javascript|scripts)\b|\bsin (?:javascript|scripts)\b"
    r"|\b(?:veuillez |merci d.)activer javascript\b|\bactivez javascript\b|\bbesoin de (?:scripts|javascript)\b|\bsans (?:javascript|scripts)\b|\bnécessite javascript\b"
    r"|\bative o javascript\b|\bprecisa d[eo] (?:javascript|scripts)\b|\bsem (?:javascript|scripts)\b|\brequer javascript\b"
    r"|включите (?:javascript|скрипты|сценарии)|(?:нужен|нужны|требуется|требуются|необходим\w*) (?:javascript|скрипты|сценарии)|без (?:javascript|скриптов)|javascript (?:отключ[её]н|необходим|нужен)"
    r"|(?:javascript|スクリプト) ?を有効|(?:javascript|スクリプト) ?が(?:必要|無効)|javascript (?:चालू|सक्षम|सक्रिय|आवश्यक|की आवश्यकता)",
    _,
)
TITLES = (
    "not found|page not found|forbidden|unauthorized|unauthorised|bad gateway|bad request|service (?:temporarily )?unavailable|gateway time-?out|request time-?out|too many requests|internal server error|method not allowed|access denied|server error|error"
    "|nicht gefunden|seite nicht gefunden|zugriff verweigert|serverfehler|interner serverfehler|nicht angemeldet|wartung|wartungsarbeiten|dienst nicht verfügbar|zu viele anfragen"
    "|página no encontrada|no encontrado|acceso denegado|error interno|error interno del servidor|error del servidor|servicio no disponible|demasiadas solicitudes|sesión caducada|no autorizado"
    "|page introuvable|non trouvé|accès refusé|erreur interne|erreur interne du serveur|erreur du serveur|service indisponible|trop de requêtes|non autorisé"
    "|página não encontrada|não encontrado|acesso negado|erro interno|erro interno do servidor|erro do servidor|serviço indisponível|muitas solicitações|não autorizado"
    "|страница не найдена|не найдено|доступ запрещ[её]н|ошибка сервера|внутренняя ошибка сервера|сервис недоступен|слишком много запросов|нет доступа|требуется вход"
    "|ページが見つかりません|アクセスが拒否されました|アクセス拒否|サーバーエラー|サーバー内部エラー|内部サーバーエラー|サービス利用不可|पृष्ठ नहीं मिला|पहुँच अस्वीकृत|प्रवेश निषेध|सर्वर त्रुटि|आंतरिक सर्वर त्रुटि|सेवा उपलब्ध नहीं"
)
TITLE = re.compile(rf"^\W*(?:(?:http (?:status |error )?|error |fehler |erreur |erro |ошибка )?(?:\d{{3}}|⟨n⟩)\W{{0,4}})?(?:{TITLES})\W*(?:\(?(?:v?\d+|v?⟨n⟩)\)?\W*)?$", _)
ERROR = re.compile(
    r"\b(?:page|link|lead|report|view|file|case|map)\b.{0,40}\b(?:does not exist|doesn.t exist|no longer exists|could not be found|cannot be found|was not found|is broken|has been removed|has moved)\b|\bcould ?n[o']t find (?:this|the|that|your) \w+|\bwas removed\b.{0,5}$"
    r"|^\W*(?:sorry, |oops\W+|whoops\W+|uh-oh\W+)?(?:access denied|permission denied)\b|\bno permission to (?:view|see|open)\b|\bnot (?:allowed|authori[sz]ed|permitted) to (?:view|see|open|access)\b"
    r"|\bsession (?:has )?(?:expired|timed out)|\b(?:log|sign) in (?:again|to (?:see|view|continue|read|open))\b|\bplease (?:log|sign) in\b|\byou (?:must|need to) (?:log|sign) in\b|\blogin required\b"
    r"|\brate limit (?:reached|exceeded|hit)|\btoo many (?:visitors|requests|attempts) (?:right now|at|from|in)|\bquota (?:for|of) .{0,30}(?:used up|exceeded|reached)|\blimit (?:has been )?(?:reached|exceeded)\b.{0,20}\b(?:slow|wait|try|later)"
    r"|\bmaintenance window\b|\b(?:down|closed|offline) for (?:scheduled )?maintenance\b|\bunder maintenance\b|\bmaintenance (?:is )?in progress\b|\b(?:come|be) back (?:soon|later|shortly)\b"
    r"|\berror (?:has )?(?:occurred|happened)\b|\b(?:unexpected|internal|unknown) error\b.{0,20}\b(?:occurred|happened)|\bsomething went wrong\b|\bmet a problem\b|\bcould not (?:finish|complete|process) (?:the|your) request|\bgave no valid answer\b|\bdid not (?:reply|respond|answer) in time\b|\b(?:backend|server|service|explorer|node)\b.{0,30}\b(?:is )?(?:not reachable|unreachable|not available right now|not responding)\b"
    r"|^\W*error establishing a\b|^\W*connection (?:was )?(?:refused|reset|closed|timed out)\b|^\W*http (?:status|error) (?:\d{3}|⟨n⟩)|^\W*err_[a-z_]{3,}\W*$|\b(?:site|page|server|host) can.?t be reached\b|\bnull pointer (?:in|at|exception)\b|^\W*at [\w.$]+\((?:\w+\.\w+:)?[\w⟨⟩]*\)\W*$|^\W*(?:the |this |a )?[\w-]+ failed to (?:load|open|start|connect|render)\W*$|\bupstream connect error\b|^\W*fatal(?: error)?:|\bout of memory in\b|^\W*segmentation fault|^\W*panic:|^\W*exception in thread|^\W*traceback \(most recent|^\W*unhandled exception|^\W*core dumped"
    r"|^\W*[a-z.]*(?:error|exception): \S|^\W*home ?(?:>|›|»|/) ?(?:\w+ ?(?:>|›|»|/) ?)*error\W*$|^\W*export failed\b|^\W*cannot (?:get|post) /|\b(?:page|lead|report|view|case) is no longer available\b|^\W*retry\?\W*$|^\W*loading\W*$|^\W*(?:failed to|cannot|could not|unable to) (?:load|open|display|connect to|reach) (?:this|the|your) (?:page|view|case|data|map|graph|report|dashboard|explorer|store|database)\b"
    r"|\bdie (?:angeforderte )?seite (?:existiert nicht|wurde nicht gefunden|wurde entfernt)|\bder bericht wurde entfernt\b|\bsie dürfen diese\b.{0,30}\bnicht (?:sehen|öffnen|aufrufen)\b|\bunerwarteter fehler\b|\bihre sitzung ist abgelaufen\b|\bmelden sie sich (?:bitte )?(?:neu |erneut |wieder )?an\b|\bwird gerade gewartet\b|\bwartungsarbeiten\b|\bversuchen sie es (?:später|erneut)\b"
    r"|\bla página (?:solicitada|pedida|que busca)\b.{0,20}\bno existe\b|\bno tiene permiso\b|\balgo ha fallado\b|\bestamos en mantenimiento\b|\bsu sesión ha (?:caducado|expirado)\b|\bha ocurrido un error\b|\bse ha producido un error\b|\bintente (?:lo )?(?:de nuevo|más tarde)\b|\binténtelo (?:de nuevo|más tarde)\b|\binicie sesión\b"
    r"|\bla page (?:demandée|recherchée)\b.{0,10}\bn.existe (?:pas|plus)\b|\bvous n.avez pas le droit\b|\bune erreur (?:inattendue )?est survenue\b|\bvotre session a expiré\b|\bsite (?:est )?en maintenance\b|\ben cours de maintenance\b|\breconnectez-vous\b|\bréessayez plus tard\b"
    r"|\ba página (?:pedida|solicitada)\b.{0,15}\bnão existe\b|\bnão tem permissão\b|\bocorreu um erro\b|\balgo deu errado\b|\bestamos em manutenção\b|\bsua sessão expirou\b|\btente (?:de novo|novamente) mais tarde\b"
    r"|(?:запрошенная |эта )?страница (?:не существует|удалена)|у вас нет (?:прав|доступа)|произошла (?:непредвиденная |внутренняя )?ошибка|ваш сеанс (?:ист[её]к|завершён)|сеанс ист[её]к|технические работы|повторите попытку|попробуйте позже|войдите (?:снова|заново)"
    r"|ページは(?:存在しません|見つかりません)|権限がありません|エラーが発生しました|メンテナンス中|セッションの有効期限|後でもう一度|再度ログイン|(?:यह )?पृष्ठ (?:मौजूद नहीं|नहीं मिला)|अनुमति नहीं है|त्रुटि हुई|रखरखाव|सत्र समाप्त|बाद में (?:फिर|पुनः)",
    _,
)
REPEATED = re.compile(r"\b([^\W\d_]{1,12})\b(?:\W{1,3}\1\b){5,}", _)
PAYLOAD = re.compile(r"\{ ?\"(?:error|errors|detail|message|fault)\" ?:", _)
DUMMY = r"(?:placeholder|dummy|filler|mock|sample|stand-in|blind|test|lorem)"
FILLER = re.compile(
    rf"^\W*(?:this is|below is|what follows is|here (?:goes|is|comes)|please ignore|following is|the following is|just|only|ignore this)\b.{{0,20}}\b{DUMMY} (?:text|copy|content|wording|paragraph|words|section|sentence)\b|^\W*{DUMMY} (?:text|copy|content|wording|paragraph)\W*(?:\(?v?(?:\d+|⟨n⟩)\)?\W*)?$"
    r"|\b(?:text|content|section|details?) (?:follows?|to follow|will follow) (?:in|with|soon|later|here|shortly)\b|\bnothing here yet\b|\b(?:type|write|say) something\b|^\W*(?:your|my|some|enter|add) (?:own )?(?:text|content|title|headline|words|name|message) here\b"
    r"|^\W*(?:more )?(?:title|description|body copy|body text|text|content|summary|narrative|caption|heading|name|copy|details?) (?:goes|comes|go|come|belongs?) here\b|^\W*(?:more )?(?:content|text|details?|summary|report|page) (?:is )?coming soon\b|^\W*coming soon\W*$|\bto be (?:written|supplied|announced|continued)\W*$"
    r"|^\W*(?:insert|write|enter|add|type|put) (?:(?:the|your|a|some) )?(?:narrative|text|summary|content|description|title|body)\b.{0,30}$|^\W*click (?:here )?to (?:edit|add)\b|^\W*(?:subheading|body text|body copy|sub-heading)\W*(?:\(?v?(?:\d+|⟨n⟩)\)?\W*)?$|^\W*heading (?:\d|⟨n⟩)\W*$|^\W*(?:first|second|third|fourth|fifth|last|another) (?:item|bullet|point|entry)\W*(?:\(?v?(?:\d+|⟨n⟩)\)?\W*)?$"
    r"|\bblindtext\b|\bplatzhaltertext\b|\bhier steht (?:später|bald|demnächst)\b|\bhier folgt (?:später|noch)\b|\btext folgt\b|\bfülltext\b|\btexto de relleno\b|\btexto (?:pendiente|por) (?:de )?redactar\b|\baquí (?:irá|va|vendrá|aparecerá)\b|\btexto de ejemplo\b"
    r"|\btexte (?:à rédiger|de remplissage|provisoire|factice)\b|\bfaux texte\b|\bviendra ici\b|\btexto (?:provisório|de preenchimento|a redigir|fictício)\b|\baqui (?:virá|entra|vai|entrará)\b|\bhier kommt (?:noch|später|bald)\b|\bici (?:viendra|le texte|votre texte)\b|текст[- ](?:заполнитель|рыба|заглушка)|здесь (?:будет|появится|позже)|текст (?:будет|появится) (?:позже|здесь)|ここに.{0,12}(?:入ります|入る|記入|書)|ダミー(?:テキスト|文)|仮の?(?:テキスト|文章)|यहाँ.{0,30}(?:आएगा|लिखें|जोड़ें|लिखा जाएगा)|नमूना पाठ",
    _,
)
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
HOME_ROW = frozenset("asdfghjklqwe")
NO_HOME = str.maketrans("", "", "".join(HOME_ROW))
MASK = re.compile("⟨[a-z]+⟩")
TAG = re.compile(r"</?[a-z][a-z0-9]*(?: [^<>]*)?>", _)
WORD = re.compile(r"[^\W\d_]+")
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\ufe0f]|<\\|[a-z]+\\|>|[\U0001f1e6-\U0001faff\u2600-\u27bf]", _)


MOJIBAKE = re.compile("[ÃÂÐÑâà][\u0080-\u00bf\u2018-\u2122ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")
#: What calls for cleaning at all.
ODD = re.compile("[ÃÂÐÑâà\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\ufe0f\U0001f1e6-\U0001faff\u2600-\u27bf]|<\\|")
#: Characters that match a letter of the patterns without being that letter in lower case.
OTHER_CASE = re.compile("[\u0130\u0131\u017f\u1c80-\u1c88]")
CHOICES = 24  # spellings of one piece of a pattern that are spelt out, at most


def spelt(op, arg) -> set[str] | None:
    """All texts, in lower case, that a piece of a parsed pattern matches, if it is certain that they are few."""
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.AT:
        return {""}
    if op is C.IN and all(o is C.LITERAL for o, _ in arg):
        return {chr(x).lower() for _, x in arg}
    if op is C.MAX_REPEAT and arg[:2] == (0, 1):
        parts, optional = [arg[2]], {""}
    elif op is C.SUBPATTERN:
        parts, optional = [arg[3]], set()
    elif op is C.BRANCH:
        parts, optional = arg[1], set()
    else:
        return None
    found = set(optional)
    for part in parts:
        texts = {""}
        for x in part:
            more = spelt(*x)
            if more is None or len(more) * len(texts) > CHOICES:
                return None
            texts = {t + m for t in texts for m in more}
        found |= texts
    return found if len(found) <= CHOICES else None


def needed(part) -> list[frozenset[str]]:
    """What a text in lower case must hold to match a parsed pattern: of each set at least one; the most telling set comes first."""
    sets, run = [], {""}
    for op, arg in part:
        texts = spelt(op, arg)
        if texts is not None and len(run) * len(texts) <= CHOICES:
            run = {r + t for r in run for t in texts}
            continue
        sets.append(run)
        run = texts or {""}
        if texts is None and op is C.SUBPATTERN:
            sets += needed(arg[3])
        elif texts is None and op is C.BRANCH and all(each := [needed(x) for x in arg[1]]):
            sets.append(set().union(*(x[0] for x in each)))
        elif texts is None and op is C.MAX_REPEAT and arg[0]:
            sets += needed(arg[2])
    return sorted((frozenset(s) for s in [*sets, run] if "" not in s), key=lambda s: -min(map(len, s)))


def quick_look(*patterns: re.Pattern) -> list[tuple[str, tuple[frozenset[str], ...]]]:
    """Derived from the patterns: a text in lower case that matches one of them holds one of these texts, and one of each set beside it."""
    look: dict[str, set[tuple[frozenset[str], ...]]] = {}
    for p in patterns:
        parsed = list(parser.parse(p.pattern, p.flags))
        alternatives = parsed[0][1][1] if len(parsed) == 1 and parsed[0][0] is C.BRANCH else [parsed]
        for sets in map(needed, alternatives):
            for text in sets[0] if sets else [""]:
                look.setdefault(text, set()).add(tuple(sets[1:]))
    pairs = sorted({(text, rest) for text, rests in look.items() for rest in rests}, key=lambda x: (len(x[0]), len(x[1])))
    kept: list[tuple[str, tuple[frozenset[str], ...]]] = []
    for text, rest in pairs:
        if not any(t in text and set(r) <= set(rest) for t, r in kept):
            kept.append((text, rest))
    return kept


def trie(texts: set[str]) -> str:
    """A pattern that finds any of the texts, letter by letter."""
    if "" in texts:
        return ""
    heads = sorted({t[0] for t in texts})
    ways = [re.escape(h) + trie({t[1:] for t in texts if t[0] == h}) for h in heads]
    return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"


#: What a text must hold for any of the patterns, and a first look for all of it at once.
QUICK = quick_look(TITLE, NOTICE, ERROR, FILLER)
LOOK = ahocorasick.Automaton()
for _text in {text for text, _rest in QUICK}:
    LOOK.add_word(_text or " ", [rest for text, rest in QUICK if text == _text])
LOOK.make_automaton()


def hopeless(u: str) -> bool:
    """Whether it is certain that none of the patterns matches: one pass over the text for all that they need."""
    low = u.lower()
    for _end, rests in LOOK.iter(low):
        for rest in rests:
            if all(any(x in low for x in r) for r in rest):
                return False
    return not OTHER_CASE.search(u)


def clean(text: str) -> str:
    """Without invisible characters, pictures and stray control tokens; common mojibake of UTF-8 read as one-byte text is undone where it can be."""
    if text.isascii():
        return INVISIBLE.sub("", text) if "<|" in text else text
    if not ODD.search(text):
        return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    if MOJIBAKE.search(text):
        for code in ("cp1252", "latin-1"):
            try:
                text = text.encode(code).decode("utf-8")
                break
            except UnicodeError:
                continue
    return unicodedata.normalize("NFC", INVISIBLE.sub("", text))


def slot(sentence: str) -> bool:
    """Whether a sentence (or line) holds an unfilled slot where a value belongs, rather than code, a usage line, or a report about notation."""
    if not HINT.search(sentence):
        return False
    found = None
    for m in SLOTS.finditer(sentence):
        if is_slot(m[0]):
            found = m
            break
    if not found or ABOUT.search(sentence):
        return False
    if any(q.start() < m.start() and m.end() < q.end() for m in SLOTS.finditer(sentence) if is_slot(m[0]) for q in QUOTED.finditer(sentence)) and not sentence.lstrip().startswith("{"):
        return any(is_slot(m[0]) for m in SLOTS.finditer(QUOTED.sub(" ", sentence)))
    return True


def is_slot(s: str) -> bool:
    first = s[0]
    inner = s.strip("[]<>(){}%#$@*|~:_!-= &;").removeprefix("lt;").removesuffix("&gt").strip()
    name = re.sub(r"\W+", "_", inner.lower())
    if s.startswith("__"):
        return not s.strip("_") or inner.lower() not in ("main", "run", "init", "name", "file", "dict", "call", "new")
    if first == "[" and not s.startswith("[["):
        if s.startswith("[object") or not s.strip("[]._… "):
            return True
        if name in NO_SLOT or not WORD.search(inner) or inner.startswith("-") or "|" in s or '"' in s or re.search(r"\d{2}", s):
            return False
        return bool(FILL.search(inner)) or name in FIELDS or name.split("_")[-1] in FIELDS or (s.isupper() and len(inner) > 1 and inner[0].isalpha())
    if first == "(":
        return True
    if first == "<" and not s.startswith(("<<", "<%")):
        if name in NO_SLOT or s[1] in "/!" or "=" in s or re.search(r"\d$", name):
            return False
        return len(inner) > 1 and re.fullmatch(r"[^\W\d]+(?:[ _.-][^\W\d]+){0,4}", inner) is not None
    if s.startswith("%%"):
        return True
    if first in ":~" or s.startswith("%") and s.endswith("%"):
        return name in FIELDS or bool(FILL.search(inner)) or "_" in name and name.split("_")[-1] in FIELDS or re.sub(r"(?<=[a-z])(?=[A-Z])", "_", inner).lower() in FIELDS
    return True


def bare(unit: str) -> str:
    """A unit without markup, bullets and quotation marks of replies."""
    return re.sub(r"\s+", " ", re.sub(r"</?[a-z][^<>]{0,60}>", " ", unit, flags=_)).strip(" \t>*#|-•–").strip()


def wording(unit: str) -> str | None:
    """The kind of residue that a line or sentence is: ``error``, ``notice``, ``filler``; None for real content and for reports about residue."""
    if "{" in unit and PAYLOAD.search(unit):
        return "error"
    if "<" in unit and (parts := TAG.split(unit))[1:]:
        return next((k for x in parts if x.strip() and (k := wording(x))), None)
    u = bare(unit)
    if not u:
        return None
    words = [w.lower() for w in WORD.findall(MASK.sub(" ", u) if "⟨" in u else u)]
    latin = sum(map(LOREM.__contains__, words))
    if latin >= 3 and latin >= 0.6 * len(words) or words[:2] == ["lorem", "ipsum"] and len(words) == 2:
        return "filler"
    if hopeless(u):
        return None
    if TITLE.search(u):
        return "error"
    if REPORT.search(u) or QUOTED.search(u) and not re.search(r"error: ", u, _):
        return None
    if NOTICE.search(u):
        return "notice"
    if ERROR.search(u):
        return "error"
    if FILLER.search(u):
        return "filler"
    return None


#: Runs of letters in the patterns and the notions: what a verdict can depend on.
_CLASSES = re.compile(r"\\[a-zA-Z]|\[[^\]]*\]|\{[^}]*\}")
FRAGMENTS = frozenset(
    x.lower() for source in (*(p.pattern for p in (TITLE, NOTICE, ERROR, FILLER, REPORT, PAYLOAD, TAG)), *concepts.NOTIONS.values(), concepts.REPORTING) for x in WORD.findall(_CLASSES.sub(" ", source))
) | LOREM
LONG = re.compile(trie({x for x in FRAGMENTS if len(x) > 3}))
PLAIN_WORD = re.compile(r"([(]?)([A-Za-z\u00c0-\u024f\u0400-\u04ff]+)([.,;:!?)]*)")
VARIABLE = "word"


@lru_cache(1 << 18)
def constant(word: str) -> str:
    """A token as templates have it: itself if a verdict may depend on it, else a stand-in with its punctuation."""
    m = PLAIN_WORD.fullmatch(word)
    if not m or OTHER_CASE.search(word) or (low := m[2].lower()) in FRAGMENTS or LONG.search(low):
        return word
    return f"{m[1]}{VARIABLE}{m[3]}"


def mere_filler(form: str) -> bool:
    """Whether a line is a word over and over, pseudo-Latin, or keys beside each other: told by all of its words, so before any of them becomes variable."""
    words = WORD.findall((MASK.sub(" ", form) if "⟨" in form else form).lower())
    if len(words) < 3:
        return False
    letters = "".join(words)
    if len(set(words)) == len(words) and len(letters.translate(NO_HOME)) >= 0.1 * len(letters):
        return False
    words = [w.lower() for w in WORD.findall(MASK.sub(" ", bare(form)))]
    if len(words) < 3:
        return False
    if len(words) - len(set(words)) >= 5 and REPEATED.search(MASK.sub(" . . . . ", form)):
        return True
    if len(words) >= 4 and len(set(words)) <= 2 and len(bare(form)) < 4 * sum(map(len, words)):
        return True
    letters = sum(map(len, words))
    return letters >= 14 and sum(len(w) for w in words if HOME_ROW.issuperset(w)) > 0.9 * letters


def verdict(template: str) -> str | None:
    """The kind of residue that a template is, by the wording rules, else by the fitted classifier, which no report passes."""
    if kind := wording(template):
        return kind
    if REPORT.search(template) or QUOTED.search(template):
        return None
    return concepts.kind_of(bare(template))
