"""What error pages, notices and filler speak of, in many languages, and a classifier of wordings by these notions.

A wording counts by the notions it joins (a page and its absence, a session and its end, scripts and the need for them), by how much of it they cover, and by the signs of a report. The
weights come from logistic regression on the labelled wordings below, fitted when the module is loaded: the same weights for any corpus. Wordings that aren't among them, and
languages that have only the notions' stems here, are recognised by the same combinations.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np

# Stems of the notions, parted by ";". Stems of scripts that part words begin a word.
NOTIONS = {
    "page": "page;url;link;website;site;web page;webpage;file;document;resource;seite;webseite;datei;página;pagina;sitio;enlace;archivo;fichier;lien;arquivo;risorsa;страниц;сайт;файл;stron;witryn;plik;bestand;ページ;サイト;リンク;页面;页;网站;链接;網頁;페이지;사이트;파일;पृष्ठ;पेज;sayfa;sida;σελίδα;الصفحة;trang",
    "gone": "not found;could not be found;couldn't find;could not find;cannot find;can't find;can't be found;doesn't exist;does not exist;no longer exist;no longer available;not available;has been removed;has been moved;has moved;been deleted;broken;isn't working;is not working;not working;nicht gefunden;existiert nicht;nicht vorhanden;nicht mehr verfügbar;no encontrad;no se encontr;no existe;ya no está;introuvable;n'existe;non trouvé;não encontrad;não existe;не найден;не существует;удален;удалён;non trovat;non esiste;inesistente;nie znalezion;nie istnieje;niet gevonden;bestaat niet;見つかりません;存在しません;未找到;找不到;不存在;찾을 수 없;존재하지 않;नहीं मिला;मौजूद नहीं;bulunamad;hittades inte;ikke fundet;nenalezen;δεν βρέθηκε;غير موجود;không tìm thấy",
    "denied": "access denied;permission denied;access is denied;forbidden;unauthorized;unauthorised;not allowed;not authorized;not authorised;no permission;not have permission;don't have permission;don't have access;no access;zugriff verweigert;kein zugriff;keine berechtigung;acceso denegado;no tiene permiso;sin permiso;accès refusé;accès interdit;non autorisé;acesso negado;sem permissão;não tem permissão;доступ запрещ;нет доступа;нет прав;accesso negato;non autorizzat;non hai i permessi;odmowa dostępu;brak dostępu;brak uprawnień;toegang geweigerd;geen toegang;アクセス拒否;アクセスが拒否;権限がありません;拒绝访问;访问被拒绝;禁止访问;没有权限;접근이 거부;액세스 거부;권한이 없;पहुँच अस्वीकृत;अनुमति नहीं;erişim engellen;åtkomst nekad",
    "session": "session;login;sitzung;sesión;sessão;сеанс;сессия;sessione;sesja;sessie;セッション;会话;會話;세션;सत्र;oturum",
    "expired": "expired;has ended;timed out;abgelaufen;caducad;expirad;expiré;истек;истёк;завершен;завершён;scadut;wygasł;verlopen;有効期限;期限切れ;过期;已过期;超时;逾時;만료;समाप्त;süresi doldu",
    "login": "log in;sign in;log back in;log on;anmelden;melden sie sich;einloggen;inicie sesión;iniciar sesión;connectez-vous;reconnectez;se connecter;faça login;entre novamente;войдите;авторизуйтесь;accedi;effettua il login;effettua l'accesso;zaloguj;inloggen;log opnieuw in;ログイン;登录;登入;로그인;लॉग इन;giriş yap",
    "error": "error;fehler;erreur;erro;errore;ошибк;сбой;błąd;błęd;fout;エラー;错误;錯誤;오류;त्रुटि;hata;chyba;fel;exception;failure;problem;oops;whoops;sorry;entschuldigung;lo sentimos;désolé;desculpe;извините;spiacenti;przepraszamy;申し訳;抱歉;죄송",
    "occurred": "occurred;happened;went wrong;has gone wrong;aufgetreten;schiefgelaufen;schief gelaufen;schiefgegangen;ha ocurrido;se ha producido;ha fallado;salió mal;est survenue;s'est produite;mal passé;ocorreu;deu errado;произошл;возникл;что-то пошло не так;si è verificat;andato storto;wystąpił;poszło nie tak;opgetreden;ging er mis;misgegaan;発生しました;问题;发生;出错;發生;발생했;문제가;हुई;oluştu",
    "server": "server;service;gateway;backend;host;database;upstream;nginx;apache;system;dienst;servidor;servicio;sistema;serveur;serviço;сервер;сервис;служба;servizio;serwer;usług;サーバ;サービス;服务器;服务;伺服器;서버;서비스;시스템;सर्वर;सेवा;sunucu",
    "down": "unavailable;not available;not responding;not reachable;unreachable;overloaded;timeout;time-out;bad gateway;internal;cannot handle;nicht verfügbar;nicht erreichbar;interner;no disponible;no responde;interno;indisponible;interne;indisponível;недоступ;не отвечает;внутренняя;non disponibile;non risponde;interno;niedostępn;nie odpowiada;wewnętrzny;niet beschikbaar;niet bereikbaar;interne;利用できません;利用不可;応答していません;内部;不可用;无法访问;无响应;내부;이용할 수 없;사용할 수 없;응답하지 않;उपलब्ध नहीं;आंतरिक",
    "maintenance": "maintenance;under construction;being updated;wartung;im aufbau;mantenimiento;en construcción;en construction;manutenção;em construção;обслуживан;технические работы;в разработке;manutenzione;in costruzione;konserwac;w budowie;przerwa techniczna;onderhoud;in aanbouw;メンテナンス;準備中;工事中;维护;維護;建设中;점검;준비 중;रखरखाव;bakım",
    "later": "try again;try later;later;come back;be back;check back;retry;refresh the page;reload;versuchen sie es;später;erneut;inténtelo;intente;más tarde;vuelva;réessayez;plus tard;ultérieurement;tente;mais tarde;попробуйте;повторите;позже;riprova;più tardi;torna;spróbuj;później;wróć;probeer;later opnieuw;kom later;後で;後ほど;もう一度;再度;稍后;重试;再试;나중에;다시 시도;बाद में;tekrar deneyin",
    "many": "too many;rate limit;quota;limit exceeded;limit reached;exceeded;zu viele;überschritten;demasiad;límite;trop de;limite;muitas;limite;слишком много;превышен;troppe;superato;zbyt wiele;przekroczono;te veel;overschreden;多すぎ;上限;过多;超过;超出;频繁;너무 많;초과;बहुत अधिक",
    "requests": "request;attempt;visitor;try;tries;anfragen;versuche;solicitud;intentos;requêtes;tentatives;solicitaç;tentativas;запрос;попыт;richiest;tentativi;żądań;prób;verzoek;pogingen;リクエスト;要求;请求;次数;요청;अनुरोध",
    "script": "javascript;java script;js;script;cookies;скрипт;сценарии;スクリプト;脚本;자바스크립트;스크립트;जावास्क्रिप्ट",
    "enable": "enable;activate;turn on;turn it on;switch on;allow;unblock;aktivieren;einschalten;zulassen;erlauben;active;activa;habilite;habilita;permita;activez;activer;autorisez;ative;ativar;включите;разрешите;attiva;abilita;attivare;włącz;inschakelen;schakel;zet;toestaan;有効;オン;启用;开启;啟用;활성화;켜;허용;सक्षम;चालू;etkinleştir",
    "need": "required;requires;needs;need;must;disabled;without;support;turned off;browser;benötig;erforder;deaktiviert;ohne;unterstützt;necesita;requiere;desactivad;sin;besoin;désactivé;nécessite;sans;precisa;requer;desativad;sem;нужен;нужн;необходим;требует;отключ;без;браузер;richiede;necessari;disabilitat;disattivat;senza;wymaga;wyłączon;bez;przeglądark;vereist;nodig;uitgeschakeld;zonder;必要;無効;ブラウザ;需要;禁用;浏览器;필요;비활성;브라우저;आवश्यक;tarayıcı",
    "dummy": "lorem;ipsum;placeholder;dummy;filler;sample;mock;blindtext;platzhalter;fülltext;beispieltext;relleno;de ejemplo;marcador;factice;remplissage;provisoire;preenchimento;provisório;de exemplo;заполнител;рыба;заглушк;пример текста;segnaposto;di esempio;riempitivo;provvisorio;zastępcz;przykładow;voorbeeldtekst;plaatshouder;opvultekst;ダミー;仮の;占位;示例;样本;더미;자리 표시;임시;예시;नमूना",
    "text": "text;copy;content;paragraph;headline;title;description;inhalt;überschrift;texto;contenido;texte;contenu;conteúdo;текст;содержание;testo;contenuto;tekst;treść;inhoud;テキスト;文章;本文;内容;文本;文字;標題;标题;텍스트;내용;본문;पाठ;metin",
    "here": "here;goes here;coming soon;to follow;follows soon;hier;folgt;demnächst;bald;aquí;próximamente;pronto;ici;bientôt;à venir;aqui;em breve;здесь;скоро;qui;a breve;presto;in arrivo;tutaj;wkrótce;już niedługo;binnenkort;volgt;ここ;近日公開;まもなく;此处;这里;在此;即将;敬请期待;여기;곧;준비;यहाँ;जल्द",
}
#: Signs of a report or of other running text. Fixed values.
REPORTING = "asked;reported;said;says;showed;shows;replied;noted;told;wrote;writes;according;analyst;customer;client;yesterday;earlier;because;since;when;after;their;his;her;he;she;they;it took;moved;sent;received;paid;traced;wallet;exchange;investigat;case;ticket;log;logs;berichtet;laut;wir;unser;kunde;weil;als;según;nuestro;cliente;porque;cuando;informó;selon;nous;notre;quand;parce;cliente;nosso;quando;porque;segundo;мы;наш;клиент;потому;когда;сообщил;noi;nostro;perché;ha detto;klient;nasz;ponieważ;kiedy;wij;onze;klant;omdat;toen;と報告;顧客;客户;我们;报告;고객;보고"
WORDLESS = re.compile("[぀-ヿ㐀-鿿가-힯ऀ-ॿ฀-๿؀-ۿ]")
MARK = re.compile("⟨[a-z]+⟩")
QUOTE = re.compile(r"[\"“”„«»`]|(?<!\w)'(?=\w)")
LETTERS = re.compile(r"[^\W\d_]")


# Stems that stand for whole words (and their plural) only.
WHOLE = frozenset("he fel erro fout bez sin sem sans log qui ici zet page site file try his her als wij noi мы hier need hata here case link host sent paid text copy".split())


def automaton() -> ahocorasick.Automaton:
    """All stems: each with its length, its notions, and whether it begins, or is, a word."""
    found: dict[str, set[str]] = {}
    for name, listed in (*NOTIONS.items(), ("report", REPORTING)):
        for stem in listed.split(";"):
            found.setdefault(stem, set()).add(name)
    out = ahocorasick.Automaton()
    for stem, names in found.items():
        out.add_word(stem, (len(stem), stem, tuple(sorted(names)), not WORDLESS.search(stem), stem in WHOLE))
    out.make_automaton()
    return out


STEMS = automaton()


def alphabetic(x: str) -> bool:
    """Whether a character belongs to a script that parts words."""
    return x.isalpha() and x < "\u0530"


#: Combinations of notions; those of scripts make a notice, those of dummy text filler, the others an error.
JOINED = (
    ("page", "gone"), ("server", "gone"), ("denied",), ("session", "expired"), ("session", "login"), ("login", "need"), ("login", "later"), ("error", "occurred"), ("error", "server"), ("error", "down"), ("error", "page"), ("error", "later"), ("server", "down"), ("page", "down"),
    ("maintenance", "page"), ("maintenance", "server"), ("maintenance", "later"), ("maintenance",), ("down", "later"), ("many", "requests"), ("many", "later"), ("occurred", "later"), ("expired", "login"), ("error",), ("gone",), ("login",), ("later",),
    ("script", "enable"), ("script", "need"), ("dummy", "text"), ("text", "here"), ("dummy",),
)
NOTICES, FILLERS = slice(27, 29), slice(29, 32)


def features(wording: str) -> tuple[float, ...] | None:
    """What a wording holds; None if it joins no notions at all."""
    low = MARK.sub(" ", wording.lower().replace("’", "'"))
    covered, found, reports = bytearray(len(low)), set(), set()
    for last, (n, stem, names, begins, whole) in STEMS.iter(low):
        at, end = last - n + 1, last + 1
        if begins and at and alphabetic(low[at - 1]):
            continue
        if whole and end < len(low) and alphabetic(low[end]) and not (low[end] == "s" and (end + 1 == len(low) or not alphabetic(low[end + 1]))):
            continue
        for name in names:
            if name == "report":
                reports.add(stem)
            else:
                found.add(name)
                covered[at:end] = b"\1" * n
    joined = [float(all(x in found for x in names)) for names in JOINED]
    if not any(joined):
        return None
    letters = [m.start() for m in LETTERS.finditer(low)]
    if not letters:
        return None
    share = sum(covered[i] for i in letters) / len(letters)
    size = len(letters) * (3 if WORDLESS.search(low) else 1)
    return (1.0, *joined, share, share * share, np.log1p(size) / 4, float(size > 120), min(len(reports), 3) / 3, float(bool(reports)), float(bool(QUOTE.search(low))), min(len(MARK.findall(wording)), 4) / 4, float("?" in wording))


# Labelled wordings the weights are fitted on.
RESIDUE = """404 Not Found|The page you requested does not exist.|This page could not be found|The file was not found on this server|Sorry, the link is broken|We can't find that page|Access denied|403 Forbidden|You do not have permission to view this page|Unauthorized
Your session has expired, please log in again|Session timed out|Please sign in to continue|You must log in to view this document|An unexpected error occurred|Something went wrong, try again later|Internal server error|An error occurred while loading the page|502 Bad Gateway|503 Service Unavailable
The service is temporarily unavailable|The server is not responding|Gateway timeout|The site is down for maintenance|We are under maintenance, please come back later|This site is under construction|Scheduled maintenance in progress|Too many requests, try later|Rate limit exceeded|Quota exceeded, please try again later
Please enable JavaScript to view this page|JavaScript is required|This site requires JavaScript|Your browser has JavaScript disabled|You need to enable JavaScript to run this app|Allow scripts to continue|Lorem ipsum dolor sit amet|This is placeholder text|Sample text goes here|Your text here|Content coming soon|Dummy text for layout
Seite nicht gefunden|Zugriff verweigert|Ihre Sitzung ist abgelaufen|Ein Fehler ist aufgetreten|Bitte aktivieren Sie JavaScript|Wartungsarbeiten, bitte später versuchen|Hier steht bald ein Text|Página no encontrada|Acceso denegado|Su sesión ha caducado|Ha ocurrido un error|Active JavaScript para continuar|Sitio en mantenimiento|Texto de relleno
Page introuvable|Accès refusé|Votre session a expiré|Une erreur est survenue|Veuillez activer JavaScript|Site en maintenance|Texte factice|Página não encontrada|Acesso negado|Sua sessão expirou|Ocorreu um erro|Ative o JavaScript|Страница не найдена|Доступ запрещён|Сеанс истёк|Произошла ошибка|Включите JavaScript|Сайт на обслуживании
ページが見つかりません|アクセスが拒否されました|エラーが発生しました|JavaScriptを有効にしてください|メンテナンス中です|पृष्ठ नहीं मिला|त्रुटि हुई|Pagina inesistente|Errore del server|Nie znaleziono strony|Fout op de server|页面不存在|服务器错误|페이지가 존재하지 않습니다|서버 오류|Oops! That page has moved|Sorry, no access|Refresh the page and try again""".replace("\n", "|").split("|")
ORDINARY = """The analyst found no error in the server logs|The customer said his session had expired before the payment was sent|We asked the exchange to enable two-factor login for the account|The exchange denied access to the funds after the freeze|The report page lists all input addresses|The link between both wallets was found in the ledger
The service moved the coins through three hops|Maintenance fees were paid from the same wallet|The mixer was under maintenance when the coins were sent|The site of the market was seized in July|The script type of the output is P2WPKH|The wallet uses a script with two of three keys|Our script reads the ledger once a day|JavaScript miners were found on the host|The client needs a copy of the document
Try the address in the explorer first, then trace it later|The request was sent to the exchange|Too many small outputs point to a dispersal|The limit of the account was raised|The sample holds ten transactions|The text of the note names the entity|Here the coins leave the chain|The content of the file was hashed|The error rate of the model is two percent|The server at this address relays blocks
He could not find the key to the wallet|They could not be found at the stated address|No link to the entity was found|The file has been moved to the archive of the case|The page count of the report is ten|A problem with the fee was solved|The log shows a timeout of the node|Users later reported the error to the service|The document is required for the review|The browser history names the exchange|Sign the report and send it later
Der Bericht nennt keinen Fehler im System|Die Seite der Börse zeigt den Kurs|Wir haben die Datei später erneut geprüft|El informe no contiene errores|La página del informe muestra los importes|El cliente envió la solicitud más tarde|Le rapport ne contient aucune erreur|La page du rapport montre les montants|Nous avons besoin du texte complet|O relatório não contém erros|A página do relatório mostra os valores
В отчёте нет ошибок|Страница отчёта показывает суммы|Мы проверили файл позже|報告書のページに金額があります|このサービスは三つの取引を送りました|报告页面列出了所有地址|该服务发送了三笔交易|보고서 페이지에 금액이 있습니다|Il rapporto non contiene errori|La pagina del rapporto mostra gli importi|Raport nie zawiera błędów|Strona raportu pokazuje kwoty|Het rapport bevat geen fouten
Later the service sent the rest|The case file is complete|Access to the wallet needs two keys|The session with the bank took two hours|The requests came from one host|Errors in the amounts were corrected|The entity's website lists an address|Login attempts came from one network|The title of the document names the case|Sample addresses follow below|The copy was filed with the case|Enable the filter to see only flagged rows|Scripts of the outputs were compared|The database holds all addresses|Support was asked for the log
How do I enable alerts for a wallet|Add the file to the case and reload the graph|The system flags a row when the limit is exceeded|Maintenance of the list is done by hand|A page of the log was printed|The quota of the plan is ten wallets|Expired orders are removed after a day|The text here describes a peel chain|You can log in with the key card|To view the page choose Reports in the menu|If the page is slow, use a filter""".replace("\n", "|").split("|")


def fitted(ridge: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Weights by Newton's method; the ridge keeps them finite."""
    rows = [(f, y) for texts, y in ((RESIDUE, 1.0), (ORDINARY, 0.0)) for t in texts if (f := features(t))]
    x, y = np.array([f for f, _ in rows]), np.array([y for _, y in rows])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w


WEIGHTS = fitted()
LEAST = 0.75  # probability from which a wording counts as residue


def probability(wording: str) -> float:
    f = features(wording)
    return float(1 / (1 + np.exp(-np.dot(f, WEIGHTS)))) if f else 0.0


def kind_of(wording: str, least: float = LEAST) -> str | None:
    """``error``, ``notice``, ``filler`` or None."""
    f = features(wording)
    if not f or 1 / (1 + np.exp(-np.dot(f, WEIGHTS))) < least:
        return None
    joined = f[1 : 1 + len(JOINED)]
    return "notice" if any(joined[NOTICES]) else "filler" if any(joined[FILLERS]) and not any(joined[:27]) else "error"
