"""Labelled exemplars of text that stands where content should be, written for this index. Fixed values, by label and language."""

from __future__ import annotations

from http import HTTPStatus

# Whole-text labels: the text as a whole must be covered.
ERROR_PAGE = [
    *[s.phrase for s in HTTPStatus if s.value >= 400],
    "Gateway Timeout Gateway Time out", "Service Temporarily Unavailable",
    "We could not find what you were looking for. The address may be mistyped, or the page has moved.",
    "Sorry, we can't find that page. It does not exist any more: it may have been removed, moved, deleted or renamed.",
    "The page you requested is missing or not available at this address. Check the link and go back to the home page.",
    "Nothing was found here, HTTP error. Return to the previous page.",
    "Oops! Something went wrong on our side. Please try again in a few minutes or contact support with this reference.",
    "An unexpected error has occurred while your request was processed. Try again later. Reference, incident ref, trace id",
    "The server met an internal error and could not complete or process the request.",
    "Application error: the server threw an exception. Contact the administrator if it keeps happening.",
    "The proxy got an invalid response from an upstream server.",
    "The upstream server did not answer in time; the request timed out and the connection was closed. Upstream request timeout.",
    "upstream connect error: connection refused, failed or reset by the remote host, disconnect before headers, failure reason",
    "Too many requests were sent from your network or address. You are rate limited: slow down, wait some seconds, then retry.",
    "error code", "error message", "error code request", "status code request id", "error status message path timestamp", "error reason details reference",
    "Страница не найдена. Возможно, адрес неверен, или страница удалена или перемещена.",
    "Запрошенная страница была удалена и больше не существует. Вернитесь на главную страницу. Ошибка.",
    "Внутренняя ошибка сервера. Что-то пошло не так, мы уже разбираемся. Попробуйте обновить страницу или повторите попытку позже.",
    "Произошла непредвиденная ошибка. Обратитесь в поддержку и назовите код.", "Слишком много запросов. Подождите и попробуйте снова позже.",
    "Сервер не ответил вовремя, время ожидания истекло, соединение закрыто. Ошибка шлюза.",
    "Die Seite wurde nicht gefunden. Sie wurde möglicherweise verschoben, umbenannt oder gelöscht.",
    "Die angeforderte Seite gibt es nicht mehr. Zurück zur Startseite. Fehler.",
    "Interner Serverfehler. Etwas ist schiefgelaufen, bitte versuchen Sie es später erneut oder noch einmal.",
    "Ein unerwarteter Fehler ist aufgetreten. Wenden Sie sich an den Support und nennen Sie die Kennung.", "Zu viele Anfragen. Bitte warten Sie einige Sekunden.",
    "Der Server hat nicht rechtzeitig geantwortet, Zeitüberschreitung, die Verbindung wurde getrennt.",
]
ACCESS_OR_OUTAGE = [
    "Access denied or forbidden. You do not have permission to view or open this page, space or resource.",
    "You are not allowed to see this content. Ask the owner or an administrator of the space for access or permission.",
    "Please sign in or log in to continue. You must be signed in or logged in to view this page.", "Enter your user name and password. Forgot password? Remember me. No account yet? Register.",
    "Your session has expired or timed out. Please sign in or log in again to continue.", "You were logged out because of inactivity. Sign in again and reload.",
    "The site is down or offline for scheduled maintenance. We will be back soon or shortly.", "We are performing upgrades. Thank you for your patience, check the status page.",
    "The service is temporarily unavailable or overloaded. Please come back or try again later. We apologise for the inconvenience.",
    "Доступ запрещён или закрыт. У вас нет прав на просмотр раздела. Обратитесь к владельцу или администратору раздела.", "Запросите доступ у владельца раздела.",
    "Войдите в систему или авторизуйтесь, чтобы продолжить. Введите логин и пароль.", "Ваша сессия истекла, время сеанса вышло. Войдите снова, чтобы продолжить.",
    "Сервис временно недоступен, попробуйте зайти позже. Код", "Сайт закрыт на техническое обслуживание, идут работы. Мы скоро вернёмся, приносим извинения.",
    "Zugriff verweigert. Sie haben keine Berechtigung für diesen Bereich. Bitte wenden Sie sich an den Eigentümer oder Administrator.", "Bitten Sie den Eigentümer um Zugriff.",
    "Bitte melden Sie sich an, um fortzufahren. Benutzername und Passwort.", "Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.",
    "Der Dienst ist vorübergehend nicht erreichbar oder nicht verfügbar. Kennung", "Wegen geplanter Wartungsarbeiten nicht verfügbar. Wir sind in Kürze wieder da, bald zurück.",
]
SCRIPT_NOTICE = [
    "This application or app needs JavaScript to run. You need to enable JavaScript in your browser settings and reload the page.",
    "JavaScript is disabled, turned off or blocked in your browser. Please enable or turn it on to view this page, then refresh.",
    "This page, panel, board, report, dashboard or wiki cannot be shown and does not work without JavaScript or scripts switched on.",
    "Scripts must be allowed or enabled for this site. Switch them on to continue.", "It can only be shown or displayed with scripts on.",
    "Please wait while we are checking your browser before opening the page. Cookies and scripts must be enabled and allowed.",
    "Loading, please wait... If nothing happens or appears, allow scripts for this site and reload.",
    "Your browser is not supported or too old for this board. Update it and try again.",
    "Приложение не работает без JavaScript. Чтобы продолжить, включите JavaScript в настройках браузера.", "Для просмотра или работы страницы, панели, доски нужен JavaScript, включите его.",
    "В вашем браузере отключены или заблокированы скрипты. Пожалуйста, включите их и обновите страницу.", "Ваш браузер устарел, обновите его. Без скриптов отчёт не показать.",
    "Проверяем браузер, загрузка, подождите. Разрешите cookie и скрипты для этого сайта.",
    "Bitte aktivieren Sie JavaScript, um diese Seite zu sehen oder anzuzeigen.", "JavaScript oder Skripte sind in Ihrem Browser deaktiviert, ausgeschaltet oder blockiert.",
    "Diese Anwendung, dieses Board, diese Ansicht benötigt aktivierte Skripte. Danach die Seite neu laden.", "Ohne Skripte funktioniert der Bericht nicht. Skripte einschalten und neu laden.",
    "Ihr Browser ist zu alt, bitte aktualisieren.", "Browser wird geprüft, bitte warten. Cookies und Skripte erlauben.",
]
# Navigation around such a text; never residue by itself.
NAVIGATION = [
    "Menu Home Start page Search Help Profile Settings", "Boards Alerts Reports Wiki Back Up Next", "Sign in Sign out Log in Log out Register", "ops portal wiki copyright", "Back to start page",
    "Menü Startseite Start Suche Hilfe Profil Boards Alarme Anmelden Abmelden Einstellungen zurück", "Меню Главная Поиск Помощь Профиль Доски Алерты Войти Выйти Настройки назад", "nginx apache server",
    "html head title body center h1 h2 p div span noscript br hr meta charset utf script style class lang en de ru doctype",
]
# Passage labels: a section, paragraph or entry of its own must be covered.
FILLER = [
    # the well-known dummy text of printers
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.",
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.",
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.",
    "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
    # typed to fill a field
    "test test test testing", "foo bar foo bar baz qux", "asdf asdf asdf asdfgh", "qwerty qwerty", "xxx xxx xxx xxxx", "abc abc abc", "bla bla bla blah blah blah", "йцукен йцукен", "фыва фыва", "тест тест тест тестовый", "qwertz qwertz", "aaa bbb ccc", "blub blub dingsda",
    "Text to follow. The text will follow later.", "Content to follow, content coming soon.", "Details to be added here later.", "To be written, to be filled in later.",
    "Sample text, example copy. Replace it before publishing.", "This is sample content, to be replaced before it is published.", "Placeholder text for this section. Placeholder copy, dummy text.", "Dummy copy for the layout of the section.",
    "Description will be added here later. A description of the problem follows.", "Here the description of the problem will be added.", "Example heading. Example paragraph. Heading and paragraph of an example.", "This is an example heading for a sample paragraph.",
    "Nothing here yet, coming soon, under construction.", "This section was left blank and is to be completed.",
    "Текст-заглушка, заменить перед публикацией.", "Это заглушка, текст нужно заменить до публикации.", "Рыба-текст для вёрстки этого раздела.", "Рыба для вёрстки, раздел.", "Здесь будет описание или текст.", "Описание появится позже.", "Текст появится здесь позже.", "Здесь позже появится описание проблемы.",
    "Пример заголовка. Пример абзаца.", "Заголовок и абзац для примера.", "Пример текста, будет заменён.", "Раздел заполнить позже.", "Содержание будет добавлено позже.",
    "Platzhaltertext für diesen Abschnitt.", "Dies ist ein Platzhalter für den Abschnitt.", "Hier steht später die Beschreibung oder der Text.", "Die Beschreibung steht später hier.", "Blindtext für das Layout, vor Veröffentlichung ersetzen.", "Blindtext, der vor der Veröffentlichung ersetzt wird.",
    "Beispieltext, vor der Veröffentlichung ersetzen.", "Text folgt, Beschreibung folgt, Inhalt folgt.", "Inhalt und Beschreibung folgen später.", "Beispielüberschrift. Beispielabsatz.", "Überschrift und Absatz als Beispiel, Beispielüberschrift, Beispielabsatz.",
]
# Marks that a template engine should have replaced: shape and field names.
MARK = [
    "{{ owner }}", "{{ service_name }}", "{{ root cause }}", "{{ incident id }}", "{{ date }}", "{{ summary text }}", "{{ link to dashboard }}", "{% block summary %}", "{% if severity %}", "{% endif %}", "${OWNER}", "${SERVICE_NAME}", "${stand}", "${incident date}",
    "<<owner>>", "<<service name>>", "<<LINK TO RUNBOOK>>", "<<root cause>>", "[[owner]]", "[[service name]]", "[[ROOT_CAUSE]]", "[[step number]]", "@@OWNER@@", "@@SERVICE_NAME@@", "@@date@@", "__OWNER__", "__SERVICE_NAME__", "__TEAM__", "%OWNER%", "%SERVICE_NAME%", "%LINK TO DASHBOARD%", "%DATE%",
    "{{ team channel contact }}", "{{ start time end time }}", "{{ impact customers affected }}", "{{ region cluster host version }}", "{{ author ticket number url }}", "{{ severity status environment }}", "{{ имя владельца }}", "{{ дата инцидента }}", "{{ причина }}", "{{ сервис }}", "{{ Name }}", "{{ Datum }}", "{{ Ursache }}", "{{ Dienst }}",
]
# Words that ask for something, in single brackets: all of an exemplar's words must stand in the mark.
ASK = ["insert here", "insert", "your", "TBD", "TBC", "TODO", "FIXME", "fill in", "fill", "enter", "goes here", "add here", "replace me", "replace with", "specify", "describe here", "describe the", "choose one", "placeholder",
       "указать", "укажите", "вставить", "вставьте", "заполнить", "заполните", "впишите", "вписать", "ваш", "ваше", "добавить сюда", "опишите", "уточнить", "уточните", "выберите",
       "eintragen", "einfügen", "einsetzen", "ausfüllen", "ergänzen", "hier angeben", "bitte angeben", "beschreiben Sie", "bitte wählen", "Platzhalter"]
