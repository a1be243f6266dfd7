"""Words of service messages, script notices, fill-in text and template fields, by language.

An entry that ends in * stands for all words with that beginning. Entries are words and short phrases that such
messages are made of, not messages: what a paragraph is follows from how much of it they cover. Words of up to
three letters, and `glue`, count neither for nor against.
"""

from __future__ import annotations

#: subject: what fails; failure: that it did; plain: failures that are common words too and need a subject or a
#: status beside them; advice: what else such messages say; state: what is said of scripts; glue: longer function words.
MESSAGES: dict[str, dict[str, str]] = {
    "English": {
        "subject": "page*, file, files, server*, service, services, site, website, resource*, document, notebook, session, request, requests, connection, address, gateway, url, link, content, preview, output, host, upstream, proxy, database, viewer, permission*, application",
        "failure": "not found, be found, unavailable, access denied, accessdenied, nosuchkey, denied, forbidden, unauthorized, unauthorised, not authorized, timed out, timeout, time-out, gateway timeout, went wrong, could not be, couldn't be, cannot be, can't be, unable to, no longer exists, no longer available, does not exist, doesn't exist, too many requests, rate limit*, rate-limit*, been limited, too large, refused, was reset, bad gateway, bad request, not allowed, not available, not have permission, no permission, has expired, expired, down for, internal server error, isn't available, aren't available, took too long, been removed, been moved, been deleted, been blocked, been suspended, been logged out",
        "plain": "error, failed, failure, problem, trouble, unexpected, invalid, interrupted, offline, gone, exceeded, maintenance, overloaded, blocked, temporarily",
        "advice": "please, try again, again, later, sorry, oops, whoops, refresh*, reload*, back, return, home, homepage, start, contact, support, administrator, sign, login, retry, wait*, minute*, second*, moment*, soon, shortly, check*, continue, report*, told, know, notified, download*, view*, access*, display*, render*, load*, requested, looking, currently, internal, status, code, message, reason, title, reference, requestid, side, system, team, technical, difficult*, visit, many, found, exists, limited, scheduled, trace, detail*, http, sent, process*, open*, large, served, show*, reach*, working, hosted, cache, retrieve*, fetch*, expired, moved, removed, deleted, took, long, respond*, find, finding, right, occurred, unfortunately, apolog*, inconvenience, having, happened, went, wrong",
        "state": "enable*, disabled, required, requires, require, turn on, turned on, turned off, switched off, activate*, allow*, blocked, trusted, needs, need to, must be, not support, switch on, not enabled, unsupported, without, necessary, mandatory",
        "browser": "browser*, chart, figure, widget, dashboard, interactive, view*, cookies, setting*, drawn, below, looks, execution, mark, work*, correctly, properly, experience, application, run, using, until, safe, human, verify*, turn, need, full, visuali*, plot, function*, feature*, proper*, javascript-enabled, scripts, disabled, enabled",
        "glue": "this, that, with, your, from, have, been, will, could, would, should, about, which, their, there, these, those, them, they, what, when, where, while, into, some, only, just, here, were, does, than, then, like, cannot, must, being, more, make, sure, without",
    },
    "Spanish and Portuguese": {
        "subject": "página*, pagina*, archivo*, arquivo*, servidor*, servicio*, serviço*, sitio*, site, recurso*, documento*, sesión, sessão, solicitud*, solicitação, conexión, conexão, enlace*, contenido*, conteúdo*, cuaderno*",
        "failure": "no encontrad*, não encontrad*, no disponible*, indisponíve*, denegado, negado, prohibido, proibido, no autorizado, não autorizado, ha expirado, caducado, expirou, algo salió mal, algo deu errado, no existe*, não existe*, no se ha podido, no se pudo, não foi possível, demasiadas solicitudes, agotado, excedido, inaccesible, no se encontró, não foi encontrad*",
        "plain": "error, erro, fallo, falha, mantenimiento, manutenção, inesperado, temporalmente, temporariamente",
        "advice": "vuelva*, inténtelo, intente*, intentar*, nuevo, más, tarde, mais, tente, novamente, favor, disculpe, lamentamos, acceso, acesso, interno, inicio, início, volver, voltar, minutos, momento, solicitad*, encontrad*, cargar*, carregar*, mostrar*, exibir*, permiso*, permissão, iniciar, actualizar, recargar, recarregue, sentimos, busca, buscas, ocurr*, ocorr*, producido, produjo, lamento*, procura",
        "state": "active, activar, activado, habilite, habilitar, ative, ativar, ativado, desactivado, desativado, requiere, requer, necesita, necesario, necessário, precisa, permita",
        "browser": "navegador*, contenido, visualizar, continuar, gráfico*",
        "glue": "para, está, este, esta, esto, isto, como, pero, puede, pode, debe, deve, seu, sido, algo, aplicación, aplicativo",
    },
    "French and Italian": {
        "subject": "page, pagina, fichier*, serveur*, server, service*, servizio, site, sito, ressource*, risorsa, document*, session*, sessione, requête, richiesta, connexion, connessione, contenu, contenuto, lien, notebook, cahier, file",
        "failure": "introuvable*, non trouvé*, non trovat*, indisponible*, non disponibil*, refusé*, negato, interdit*, vietato, non autorisé*, non autorizzat*, expiré*, scadut*, mal passé, andato storto, n'existe*, non esiste*, impossible, impossibile, trop de, troppe, délai, inaccessible*, irraggiungibile, n'a pas pu",
        "plain": "erreur*, errore, échec, maintenance, manutenzione, inattendue, imprevisto, temporairement, temporaneamente, problème, problema",
        "advice": "veuillez, réessayer, réessayez, plus, tard, prego, riprova*, più, tardi, désolé*, spiacenti, accès, accesso, interne, interno, accueil, retour, torna*, minutes, minuti, instants, demandée, demandé, richiest*, chargé*, caricat*, affich*, visualizzat*, permission*, reconnecter, accedi, requêtes, richieste, actualis*, survenue, survenu, produite, produit, verificat*, recherchée, recherchez, cercata, cercando, malheureusement, purtroppo",
        "state": "activer, activez, activé, désactivé, autoriser, autorisez, nécessaire, nécessite, requis, abilita*, attiva*, disabilitat*, disattivat*, necessario, richiede, bloqué*, bloccat*",
        "browser": "navigateur*, browser, continuer, continuare, graphique, grafico, afficher, utiliser, correctement, contenu",
        "glue": "dans, votre, pour, avec, cette, être, quelque, chose, questa, questo, sono, stata, stato, della, nella, qualcosa, sans, vous, avez, cela, tuo, nel",
    },
    "German, Dutch and Scandinavian": {
        "subject": "seite*, datei*, server*, dienst*, webseite*, website*, sitzung*, anfrage*, verbindung*, inhalt*, dokument*, pagina*, bestand*, dienst, service*, sessie, verzoek*, verbinding, inhoud, sidan, siden, filen, tjänsten, tjenesten, servern, serveren, notebook*, ressource*",
        "failure": "nicht gefunden, nicht verfügbar, verweigert, verboten, abgelaufen, schiefgelaufen, schief gelaufen, existiert nicht, nicht erreichbar, zu viele, zeitüberschreitung, konnte nicht, konnten nicht, niet gevonden, niet beschikbaar, geweigerd, verlopen, misgegaan, bestaat niet, te veel, kon niet, hittades inte, inte hittas, ikke fundet, ikke funnet, blev ikke fundet, nekad, nægtet, nektet, inte tillgänglig*, ikke tilgængelig*, ikke tilgjengelig*, gick fel, gik galt, gikk galt",
        "plain": "fehler*, interner, wartung*, wartungsarbeiten, unerwarteter, fout, onderhoud, fel, fejl, feil, underhåll, vedligeholdelse, vorübergehend, tijdelijk, tillfälligt, midlertidigt",
        "advice": "bitte, versuchen, erneut, später, entschuldigung, leider, zugriff, zurück, startseite, minuten, angefordert*, angeforderte*, geladen, angezeigt, berechtigung, anmelden, probeer, opnieuw, later, helaas, toegang, terug, minuten, gevraagde, försök, igen, senare, prøv, senere, beklager, åtkomst, adgang, tilgang, kunde, kunne, momentan, anfragen, aufgetreten, melden, opgetreden, tyvärr, uppstod, opstod, oppstod, desværre, dessverre, gesuchte, unerwartet*, länger, meer, uppstått, opstået",
        "state": "aktivieren, aktiviert, deaktiviert, erforderlich, benötigt, erlauben, zulassen, ingeschakeld, inschakelen, schakel, uitgeschakeld, vereist, nodig, aktivera*, aktiver, aktivere, inaktiverat, deaktiveret, krävs, kræver, krever, eingeschaltet, abgeschaltet",
        "browser": "browser*, anzuzeigen, anzeigen, nutzen, verwenden, fortzufahren, weergeven, bekijken, webbläsare*, nettleser*, darstellung, diagramm, ansehen",
        "glue": "diese, dieser, dieses, nicht, wird, wurde, werden, haben, sind, eine, einen, ihren, ihrem, sich, etwas, kann, muss, deze, wordt, niet, heeft, naar, voor, werd, iets, inte, ikke, denna, denne, från, din, diese, um, damit, auf, zur, efter, att, du, must, moet, uw",
    },
    "Polish, Czech and Turkish": {
        "subject": "stron*, plik*, serwer*, usług*, sesja, żądan*, połączen*, zasób, stránk*, soubor*, server*, služb*, relace, požadav*, připojení, obsah, sayfa*, dosya*, sunucu*, hizmet*, oturum*, istek*, bağlantı*, içerik, dokument*",
        "failure": "nie znaleziono, nie została znaleziona, nie istnieje, niedostępn*, odmowa, zabroniony, wygasła, poszło nie tak, zbyt wiele, nie można, nenalezen*, nebyla nalezena, neexistuje, nedostupn*, odepřen*, zakázán*, vypršel*, pokazilo, příliš mnoho, nelze, bulunamadı, mevcut değil, kullanılamıyor, engellendi, reddedildi, yasak*, süresi doldu, ters gitti, çok fazla, yapılamadı, erişilemiyor",
        "plain": "błąd, wewnętrzny, konserwacja, chyba, chyba, interní, údržba, hata*, bakım*, tymczasowo, dočasně, geçici, dahili",
        "advice": "spróbuj, ponownie, później, proszę, przepraszamy, dostęp*, dostępu, powrót, minut, zkuste, znovu, později, prosím, omlouváme, přístup, zpět, lütfen, tekrar, daha, sonra, deneyin, üzgünüz, erişim, dakika, istenen, aradığınız, geri, požadovaná, znaleziona, żądana, wystąpił*, došlo, nastala, oluştu, bohužel, niestety, szukana, hledaná, serwera, zkuste",
        "state": "włącz*, wyłączon*, wymagan*, obsług*, zapněte, povolte, povolen*, zakázán*, vyžaduje, potřebuje, vypnut*, etkinleştirin, etkinleştirilmeli*, devre dışı, gerekli*, gerektir*, izin",
        "browser": "przeglądar*, wyświetl*, prohlížeč*, zobrazen*, zobrazit, tarayıcı*, görüntülemek, devam, kontynuować, pokračovat",
        "glue": "jest, aby, twoja, nie, została, tato, byla, není, aby, pro, bir, için, şeyler, coś, něco, ve, svém, swojej, bu, i̇çeriği, içeriği, tento, tego, tej",
    },
    "Russian, Ukrainian and Greek": {
        "subject": "страниц*, файл*, сервер*, сервис*, служб*, сеанс*, сесси*, запрос*, соединен*, ресурс*, сайт*, сторінк*, послуг*, σελίδα, σελίδας, αρχείο, διακομιστή*, υπηρεσία, συνεδρία, αίτημα, σύνδεση, документ*, контент, содержим*",
        "failure": "не найден*, недоступ*, запрещен*, запрещён*, отказано, истек*, истёк*, пошло не так, слишком много, не существует, не удалось, превышен*, не знайдено, заборонен*, недоступн*, δεν βρέθηκε, δεν είναι διαθέσιμ*, απορρίφθηκε, απαγορεύεται, έληξε, πήγε στραβά, δεν υπάρχει, πάρα πολλά, не вдалося",
        "plain": "ошибк*, внутренн*, техническ*, обслуживан*, временно, помилк*, тимчасово, σφάλμα, εσωτερικό, συντήρηση, προσωρινά",
        "advice": "попробуйте, повторите, попытк*, позже, пожалуйста, извините, доступ*, вернуться, главную, минут*, спробуйте, пізніше, запрашиваем*, обновите, войдите, снова, παρακαλώ, δοκιμάστε, ξανά, αργότερα, λυπούμαστε, πρόσβαση, λεπτά, работы, ведутся, еще, раз, ещё, ζητήσατε, произошл*, возникл*, сталася, παρουσιάστηκε, προέκυψε, сожалению, δυστυχώς",
        "state": "включите, включен*, включить, отключен*, отключён*, требуется, необходим*, разрешите, увімкніть, вимкнено, ενεργοποιήστε, ενεργοποιημένη, απενεργοποιημένη, απαιτείται, нужен, поддержк*",
        "browser": "браузер*, просмотр*, отображен*, увидеть, продолжить, продолжения, браузері, πρόγραμμα, περιήγησης, προβάλετε, συνεχίσετε, δείτε, περιηγητή",
        "glue": "этот, этой, этого, чтобы, была, было, вашем, ваш, для, цей, була, σας, στο, για, την, αυτή, αυτό, кое, что-то, что, που, να, κάτι",
    },
    "Chinese, Japanese and Korean": {
        "subject": "页面, 頁面, 文件, 服务器, 伺服器, 服务, 会话, 请求, 连接, 资源, 网站, 網站, ページ, ファイル, サーバー, サーバ, サービス, セッション, リクエスト, 接続, コンテンツ, 페이지, 파일, 서버, 서비스, 세션, 요청, 연결, 内容, 콘텐츠",
        "failure": "不存在, 找不到, 未找到, 无法访问, 無法, 无法, 被拒绝, 拒绝, 不可用, 已过期, 禁止, 出错, 超时, 见つかりません, 見つかりません, 拒否, 利用できません, 期限切れ, 禁止されて, できません, できませんでした, タイムアウト, 찾을 수 없, 거부, 사용할 수 없, 만료, 수 없습니다, 过多, 多すぎ",
        "plain": "错误, 錯誤, 内部, 维护, エラー, 問題, メンテナンス, 오류, 점검, 暂时",
        "advice": "请, 請, 稍后, 稍後, 再试, 再試, 重试, 抱歉, 对不起, 访问, 返回, 首页, しばらくして, もう一度, お試しください, 申し訳ありません, アクセス, お探しの, 戻る, ください, 発生しました, 다시, 시도, 잠시 후, 죄송합니다, 접근, 접속, 해 주세요, 하세요, 您, 的, 了, を, が, は, の, に, へ, お, 이, 을, 를, 가, 은, 는, 하려면, 후, 해, 주세요, 습니다, されました, ました, した, て, 时, 时间, 刷新, 登录, 过, 요청하신, 입니다, です, 发生, 發生, 発生, 발생, 했습니다, ません, が発生",
        "state": "启用, 啟用, 开启, 禁用, 需要, 有効, 無効, 必要, 許可, 활성화, 비활성화, 필요, 사용, オン, 打开, 켜",
        "browser": "浏览器, 瀏覽器, 查看, 显示, 图表, 以, 才能, 继续, ブラウザ, 表示, 閲覧, するには, して, 続行, グラフ, 브라우저, 보려면, 계속, 표시, 에서, 하고, 중, 在, 中, 此, 本, この, その, で, ため, 내용",
        "glue": "",
    },
    "Arabic, Vietnamese and Indonesian": {
        "subject": "الصفحة, الملف, الخادم, الخدمة, الجلسة, الطلب, الاتصال, المحتوى, الموقع, trang, tập tin, tệp, máy chủ, dịch vụ, phiên, yêu cầu, kết nối, halaman, berkas, server, peladen, layanan, sesi, permintaan, koneksi, konten, nội dung",
        "failure": "غير موجودة, غير موجود, تعذر, رفض, مرفوض, غير متاحة, غير متاح, انتهت, ممنوع, không tìm thấy, bị từ chối, từ chối, không khả dụng, hết hạn, không tồn tại, quá nhiều, không thể, bị cấm, tidak ditemukan, ditolak, tidak tersedia, kedaluwarsa, tidak dapat, terlalu banyak, terlarang",
        "plain": "خطأ, صيانة, داخلي, lỗi, bảo trì, nội bộ, kesalahan, pemeliharaan, sementara, tạm thời, مؤقتا",
        "advice": "يرجى, حاول, المحاولة, مرة, أخرى, لاحقا, لاحقًا, عذرا, عذرًا, الوصول, العثور, على, الرجاء, vui lòng, thử lại, thử, lại, sau, xin lỗi, truy cập, quay lại, phút, silakan, coba, lagi, nanti, maaf, akses, kembali, menit, mohon, حدث, المطلوبة, xảy ra, đã, terjadi, diminta, rồi, này, muộn, tìm, gặp, mengalami, ditemukan",
        "state": "تمكين, تفعيل, تعطيل, مطلوب, bật, kích hoạt, bị tắt, cần, yêu cầu, aktifkan, diaktifkan, dinonaktifkan, diperlukan, memerlukan, membutuhkan",
        "browser": "المتصفح, متصفحك, لعرض, للمتابعة, trình duyệt, xem, hiển thị, tiếp tục, peramban, browser, melihat, menampilkan, melanjutkan",
        "glue": "هذا, هذه, في, من, này, trong, của, được, để, tới, nhé, untuk, pada, ini, anda, yang, harus, dari, bạn",
    },
}

#: Words by which such a message pleads for patience or excuses itself; with one of them a plain failure is one.
PLEAS = "try again, sorry, oops, whoops, unfortunately, retry, administrator, occurred, notified, apolog*, inconvenience, later, having, vuelva*, inténtelo, intente*, tente, novamente, disculpe, lamentamos, sentimos, ocurrido, ocurrió, ocorreu, producido, veuillez, réessayer, réessayez, désolé*, malheureusement, survenue, produite, riprova*, spiacenti, purtroppo, verificato, versuchen, erneut, entschuldigung, leider, aufgetreten, probeer, opnieuw, helaas, opgetreden, försök, tyvärr, uppstod, prøv, beklager, desværre, dessverre, opstod, oppstod, spróbuj, ponownie, przepraszamy, niestety, wystąpił*, zkuste, znovu, omlouváme, bohužel, došlo, nastala, tekrar, üzgünüz, oluştu, попробуйте, повторите, извините, произошл*, возникл*, сожалению, спробуйте, сталася, δοκιμάστε, λυπούμαστε, δυστυχώς, παρουσιάστηκε, προέκυψε, 再试, 再試, 重试, 抱歉, 对不起, 发生, 發生, もう一度, お試しください, 申し訳ありません, 発生, 다시, 죄송합니다, 발생, حاول, عذرا, عذرًا, حدث, thử lại, xin lỗi, xảy ra, coba, maaf, terjadi"

#: What script notices are about, in every language.
SCRIPT_NOUNS = "javascript*, java script, js, script, scripts, scripting, noscript, джаваскрипт, 자바스크립트, 스크립트, スクリプト, 脚本, جافا سكريبت, جافاسكريبت, скрипты, skripte"

#: Fill-in text: words and phrases that mean nothing.
FILLER = "lorem, ipsum, lipsum, dolor sit amet, consectetur adipiscing, sample paragraph, sample text, sample content, no meaning, text goes here, text here, content goes here, paragraph text, dummy text, placeholder text, filler text, insert text here, quick brown fox, lazy dog, qwerty, qwertz, azerty, uiop, asdf, asdfgh, asdfghjkl, jkl, zxcv, zxcvb, zxcvbn, hjkl, blah, bla, yada, foo bar, foo, bar, baz, xxx, xyz, abc, test, text, dummy, la, hamburgefonstiv, etaoin shrdlu, your, this is a, it has, more, goes here, texto de ejemplo, texto de relleno, texte factice, faux texte, blindtext, platzhaltertext, mustertext, testo segnaposto, testo di prova, opvultekst, voorbeeldtekst, przykładowy tekst, örnek metin, текст-заполнитель, пример текста, рыба-текст, 示例文本, 占位文本, 测试文本, ダミーテキスト, サンプルテキスト, 더미 텍스트, 샘플 텍스트, نص تجريبي, tekst, hier steht, beispieltext, exemple de texte, esempio di testo, aquí va el texto, jumps over the, the"
#: Of the above, those that make a paragraph fill-in text; the others only fill it.
FILLER_CORES = "lorem, ipsum, lipsum, dolor sit amet, consectetur adipiscing, sample paragraph, sample text, sample content, text goes here, your text here, content goes here, paragraph text, dummy text, placeholder text, filler text, insert text here, quick brown fox, qwerty, qwertz, azerty, asdf, asdfgh, asdfghjkl, zxcvb, hjkl, blah, bla bla, yada, foo bar, xxx, xyz xyz, abc abc, test test, text text, dummy dummy, la la, hamburgefonstiv, etaoin shrdlu, texto de ejemplo, texto de relleno, texte factice, faux texte, blindtext, platzhaltertext, mustertext, testo segnaposto, testo di prova, opvultekst, voorbeeldtekst, przykładowy tekst, örnek metin, текст-заполнитель, рыба-текст, 示例文本, 占位文本, ダミーテキスト, サンプルテキスト, 더미 텍스트, 샘플 텍스트, نص تجريبي, beispieltext, exemple de texte"
#: Words by which Latin fill-in text is met, and endings by which the rest of it is told from living languages.
LATIN_SIGNS = "lorem, ipsum, amet, consectetur, adipiscing, adipisci, nostrud, fugiat, quisquam, aliqua, aliquam, aliquip, ullamco, ullam, eiusmod, incididunt, labore, veniam, tempor, porro, vivamus, vestibulum, curabitur, pellentesque, suspendisse, phasellus, maecenas, aenean, donec, quisque, praesent, nullam, fusce, sagittis, faucibus, laoreet, rutrum, perspiciatis, voluptatem, morbi, tristique, senectus, malesuada, fames, turpis, egestas, fringilla, ullamcorper, mauris, tincidunt, venenatis, condimentum, ligula, porttitor, dapibus, blandit, metus, accusantium, doloremque, laudantium, reprehenderit, cupidatat, excepteur"
LATIN_ENDINGS = ("a", "e", "i", "o", "us", "um", "is", "it", "et", "ur", "nt", "am", "em", "as", "es", "or", "at", "ut", "ed", "in", "ex", "ad", "ab", "ac", "im")

#: Marks that open a template field, what closes it, and what it holds: a name, capitals, a few words, or anything.
FIELDS: tuple[tuple[str, str, str], ...] = (
    ("{{", "}}", "name"), ("@@", "@@", "name"), ("${", "}", "name"), ("#{", "}", "name"), ("{%", "%}", "any"), ("<%", "%>", "any"), ("[[", "]]", "name"), ("&lt;", "&gt;", "words"), ("__", "__", "capitals"), ("%", "%", "capitals"), ("<", ">", "line"), ("{", "}", "braces"),
    ("YOUR_", "_HERE", "capitals"), ("INSERT_", "_HERE", "capitals"), ("ENTER_", "_HERE", "capitals"), ("ADD_", "_HERE", "capitals"),
)
#: Beginnings of bracketed instructions, any case.
BRACKETED = "insert, enter, add, your, todo, tbd, placeholder, company, customer, name of, fill in, describe, inserte, insertar, introduzca, nombre, insérer, insérez, votre, inserisci, nome, insira, einfügen, hier, ihr, vul, naam, wstaw, vložte, введите, вставьте, укажите, 请输入, 插入, 入力, ここに, 입력, أدخل, isim, nhập, masukkan, εισάγετε"
#: Ends of bracketed instructions, any case.
BRACKET_ENDS = "here, hier, einfügen, eingeben, ergänzen, aquí, ici, qui, aqui, tutaj, sem, buraya, girin, здесь, тут, εδώ, invullen, invoegen, här, her, di sini, ở đây"
#: Instructions to the author; … stands for up to four words between two halves.
INSTRUCTIONS = "write your … here, add your … here, describe your … here, put your … here, enter your … here, insert your … here, type your … here, write a … here, add a … here, describe the … here, click to edit, click to add, double-click to edit, (edit me), goes here>, replace this line with, replace this text with, replace this cell with, replace this section with, to be filled in, to be completed, fill in this section, todo: write, todo: add, todo: fill, todo: describe, todo: insert, todo: replace, delete this line, delete this cell, haga clic para editar, haga clic para agregar, escriba aquí, escriba su … aquí, cliquez pour modifier, cliquez pour ajouter, écrivez votre … ici, saisissez votre … ici, à compléter, zum bearbeiten klicken, klicken sie … zu bearbeiten, text hier einfügen, hier text eingeben, geben sie hier, fare clic per modificare, fai clic per modificare, inserisci qui, scrivi qui, clique para editar, escreva aqui, insira aqui, klik om te bewerken, typ hier, voer hier, kliknij … edytować, wpisz tutaj, klikněte pro úpravu, sem napište, düzenlemek için tıklayın, buraya yazın, нажмите … изменить, введите текст, вставьте текст, 点击编辑, 单击此处, 在此处输入, 在此输入, 请在此, 請在此, ここに … 入力, ここに … 記入, クリックして編集, 여기에 입력, 클릭하여 편집, انقر للتحرير, أدخل النص هنا, nhấp để chỉnh sửa, nhập văn bản, klik untuk mengedit, masukkan teks, κάντε κλικ για επεξεργασία"
