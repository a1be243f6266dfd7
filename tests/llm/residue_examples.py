"""Residue as readers meet it, by kind and language.

DEVELOPED was looked at while the lexicon was written. HELD_OUT was written afterwards and the lexicon not changed
for it; the recall on it is in the README. PROSE only deals with such things.
"""

DEVELOPED = {
    "error_page": {
        "en": ['502 Bad Gateway', "We're sorry, but this page isn't available right now.", "This site can't be reached. The server took too long to respond.", 'You have exceeded your rate limit. Please wait a few minutes before you try again.', "Hmm. We're having trouble finding that site.", '403 - Forbidden: Access is denied.', 'An internal error has occurred. Please contact the administrator.'],
        "es": ['Lo sentimos, la página que busca no existe.', 'Error interno del servidor. Inténtelo de nuevo más tarde.', 'Acceso denegado. No tiene permiso para ver este contenido.'],
        "fr": ["Désolé, cette page n'existe pas.", 'Le service est temporairement indisponible. Veuillez réessayer plus tard.', 'Accès refusé : votre session a expiré.'],
        "de": ['Leider ist ein Fehler aufgetreten. Bitte versuchen Sie es später erneut.', 'Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.', 'Der Server ist vorübergehend nicht erreichbar.'],
        "it": ['Si è verificato un errore imprevisto. Riprova più tardi.', 'La pagina richiesta non esiste.'],
        "pt": ['O servidor está temporariamente indisponível.', 'Ocorreu um erro inesperado. Tente novamente mais tarde.'],
        "nl": ['Er is iets misgegaan. Probeer het later opnieuw.', 'Deze pagina bestaat niet meer.'],
        "pl": ['Wystąpił błąd serwera. Spróbuj ponownie później.'],
        "cs": ['Stránka nebyla nalezena.', 'Omlouváme se, služba je dočasně nedostupná.'],
        "ru": ['Извините, запрашиваемая страница не существует.', 'Сервер временно недоступен. Попробуйте позже.'],
        "el": ['Η σελίδα δεν βρέθηκε.'],
        "vi": ['Không tìm thấy trang.', 'Đã xảy ra lỗi. Vui lòng thử lại sau.'],
        "tr": ['Aradığınız sayfa bulunamadı.'],
        "zh": ['抱歉,您访问的页面不存在。', '服务器错误,请稍后重试。'],
        "ja": ['申し訳ありませんが、ページが見つかりませんでした。'],
        "ko": ['요청하신 페이지를 찾을 수 없습니다.'],
        "ar": ['عذرا، الصفحة المطلوبة غير موجودة.'],
        "id": ['Halaman tidak ditemukan.'],
        "sv": ['Sidan kunde tyvärr inte hittas.'],
    },
    "script_notice": {
        "en": ['This application requires JavaScript. Please turn it on in your browser settings.', 'For full functionality of this site it is necessary to enable JavaScript.', 'Scripts are blocked. Trust this notebook to see the widget.'],
        "es": ['Debe habilitar JavaScript para ver esta página.'],
        "fr": ['Cette page nécessite JavaScript.'],
        "de": ['Diese Seite benötigt JavaScript.'],
        "it": ['Per visualizzare questo contenuto è necessario attivare JavaScript.'],
        "pt": ['Ative o JavaScript para continuar.'],
        "nl": ['Schakel JavaScript in om deze pagina te bekijken.'],
        "pl": ['Ta strona wymaga obsługi JavaScript.'],
        "cs": ['Pro zobrazení povolte JavaScript.'],
        "ru": ['Для просмотра включите JavaScript в браузере.'],
        "zh": ['请在浏览器中启用 JavaScript。'],
        "ja": ['このページを表示するにはJavaScriptを有効にしてください。'],
        "ko": ['계속하려면 자바스크립트를 활성화하세요.'],
        "tr": ["Bu sayfayı görüntülemek için JavaScript'i etkinleştirin."],
        "ar": ['يرجى تفعيل جافا سكريبت لعرض المحتوى'],
    },
    "placeholder": {
        "en": ['TODO: add a short summary of the data', '[Company Name], [Street Address]', 'Enter your project description here.', 'Hello {{customer.first_name}}, thank you for your order.', '[TODO: describe the model]'],
        "es": ['[Inserte aquí el título]', 'Haga clic para editar el título'],
        "fr": ['Cliquez pour modifier le titre', '[Insérez votre nom]'],
        "de": ['[Titel hier einfügen]', 'Klicken Sie, um den Titel zu bearbeiten'],
        "it": ['Fare clic per modificare il titolo'],
        "pt": ['Clique para editar o texto'],
        "zh": ['点击编辑标题'],
        "ja": ['ここにタイトルを入力'],
        "ru": ['[Введите название]'],
    },
    "filler": {
        "la": ['Vivamus sagittis lacus vel augue laoreet rutrum faucibus dolor auctor.', 'Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium.', 'Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas.', 'Donec ullamcorper nulla non metus auctor fringilla.'],
        "en": ['asdf asdf qwerty asdf'],
        "de": ['Dies ist ein Blindtext. Blindtext Blindtext Blindtext.'],
        "es": ['Texto de ejemplo. Texto de ejemplo.'],
        "fr": ['Ceci est un faux texte. Faux texte, faux texte.'],
    },
}
HELD_OUT = {
    "error_page": {
        "en": ['504 Gateway Time-out', "Sorry, we can't find the page you were looking for.", 'The requested resource is no longer available.', 'Access to this resource is forbidden.', 'Your request could not be processed. Please try again.', 'Failed to load notebook preview'],
        "es": ['El servicio no está disponible en este momento.', 'Se ha producido un error. Por favor, inténtelo más tarde.', 'Su sesión ha caducado. Vuelva a iniciar sesión.', 'Archivo no encontrado'],
        "fr": ['Une erreur est survenue. Veuillez réessayer.', 'Fichier introuvable', "Vous n'êtes pas autorisé à accéder à cette page.", 'Erreur 500 : erreur interne du serveur'],
        "de": ['Zugriff verweigert. Sie haben keine Berechtigung.', 'Der Dienst ist derzeit nicht verfügbar.', 'Die Datei konnte nicht geladen werden.', '404 Seite nicht gefunden'],
        "it": ['Accesso negato', 'Servizio temporaneamente non disponibile', 'Siamo spiacenti, si è verificato un problema.', 'File non trovato'],
        "pt": ['Página não encontrada', 'Não foi possível carregar o conteúdo.', 'Sua sessão expirou. Faça login novamente.'],
        "nl": ['Toegang geweigerd', 'De server is tijdelijk niet beschikbaar.', 'Sorry, de pagina kon niet worden gevonden.'],
        "pl": ['Nie znaleziono strony', 'Odmowa dostępu', 'Usługa jest tymczasowo niedostępna.'],
        "ru": ['Ошибка 404. Страница не найдена.', 'Произошла ошибка. Повторите попытку позже.', 'Доступ запрещен', 'Ваш сеанс истек. Войдите снова.'],
        "zh": ['页面未找到', '服务暂时不可用,请稍后再试', '访问被拒绝'],
        "ja": ['アクセスが拒否されました', 'サーバーエラーが発生しました。しばらくしてからもう一度お試しください。', 'ファイルが見つかりません'],
        "ko": ['접근이 거부되었습니다', '서버 오류가 발생했습니다. 잠시 후 다시 시도해 주세요.'],
        "tr": ['Erişim engellendi', 'Bir hata oluştu. Lütfen tekrar deneyin.'],
        "vi": ['Máy chủ tạm thời không khả dụng.'],
        "cs": ['Přístup odepřen'],
        "sv": ['Ett fel uppstod. Försök igen senare.'],
        "ar": ['حدث خطأ في الخادم. يرجى المحاولة لاحقا.'],
        "id": ['Terjadi kesalahan. Silakan coba lagi nanti.'],
        "el": ['Παρουσιάστηκε σφάλμα. Δοκιμάστε ξανά αργότερα.'],
    },
    "script_notice": {
        "en": ['JavaScript must be enabled in order to view this chart.', 'Your browser does not support JavaScript or it has been disabled.', 'We need JavaScript to render this page.'],
        "es": ['Necesita activar JavaScript para usar esta aplicación.', 'JavaScript está desactivado en su navegador.'],
        "fr": ['Activez JavaScript pour afficher ce graphique.', 'JavaScript est désactivé dans votre navigateur.'],
        "de": ['JavaScript ist deaktiviert.', 'Aktivieren Sie JavaScript, um fortzufahren.'],
        "it": ['Abilita JavaScript nel tuo browser per continuare.'],
        "pt": ['É necessário habilitar o JavaScript para visualizar esta página.'],
        "nl": ['JavaScript is uitgeschakeld in uw browser.'],
        "pl": ['Włącz JavaScript w swojej przeglądarce.'],
        "ru": ['Для работы сайта необходимо включить JavaScript.'],
        "zh": ['此页面需要启用JavaScript才能显示'],
        "ja": ['JavaScriptが無効になっています。有効にしてください。'],
        "ko": ['이 페이지를 보려면 JavaScript를 활성화해야 합니다.'],
        "tr": ['JavaScript devre dışı bırakılmış.'],
    },
    "placeholder": {
        "en": ['Insert your abstract here', '[Your Name]', 'TODO: describe the results', 'Report for ${client_name}', '<PROJECT TITLE>'],
        "es": ['Escriba su resumen aquí', '[Nombre del autor]'],
        "fr": ['[Votre titre ici]'],
        "de": ['[Hier Text einfügen]'],
        "it": ['Inserisci qui il testo'],
        "pt": ['[Insira o nome do projeto]'],
        "nl": ['Klik om te bewerken'],
        "ru": ['Введите текст здесь'],
        "zh": ['请在此处输入标题'],
        "ja": ['ここに本文を入力してください'],
        "ko": ['여기에 입력하세요'],
    },
    "filler": {
        "la": ['Curabitur blandit tempus porttitor. Nullam quis risus eget urna mollis ornare vel eu leo.', 'Integer posuere erat a ante venenatis dapibus posuere velit aliquet.', 'Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris.'],
        "de": ['Hier steht ein Beispieltext. Beispieltext.'],
        "it": ['Testo segnaposto, testo segnaposto.'],
        "en": ['Sample text goes here. Sample text goes here.'],
    },
}
PROSE = ['The service was unavailable for two days in March, so those rows are empty.', 'Error rates by server and month', '## Request errors', 'We removed pages that returned 404 from the crawl.', 'Mean squared error of the model on the test set: 0.31', 'The file is too large for Git, so we read it from the bucket.', 'JavaScript is the most common language in the survey.', 'The dashboard does not require JavaScript unless filters are used.', 'Access to the archive was denied to journalists until 1994.', 'Try again with a smaller learning rate.', 'The session ended at 14:05.', 'See [insert sort](https://example.org) for the details.', 'Der Fehler der Messung liegt bei drei Prozent.', 'La page 12 du rapport donne les chiffres.', 'El servidor guarda los datos cada hora.', 'The connection between rainfall and yield is weak.', 'Set `${HOME}` before you start.', '$\\{{x}\\}$ is a set.', 'The {mean} of the column', 'Not found in the table: 12 stations.', 'Loading data... done', 'File saved.', 'No errors.', 'Warning: column dropped', 'The test text contains lorem ipsum as a marker.', '404 birds were ringed in May.']
