"""Residue in wordings that are in no exemplar and no table, to measure recall on the unseen; and content that talks about such things."""

PAGES = [
    "Page not found. The link you followed may be broken.", "404: there is nothing at this address.", "Whoops, we can't seem to find that page. Go home or search.", "This document has been moved or no longer exists.", "HTTP 500. The server ran into a problem and could not finish your request.",
    "Sorry! An error occurred on the server. Please retry in a moment.", "Bad gateway: invalid response received from the upstream server.", "The connection to the server timed out. Try reloading the page.", "You have made too many requests. Please wait a few seconds and try again.",
    "Access to this page is forbidden. Contact your administrator.", "You don't have access. Ask the owner to give you permission.", "Please log in first. Your session is no longer valid because it expired.", "Sign in to view this space. User name. Password.", "Session timed out, please sign in again.",
    "We are currently performing maintenance and will be back online soon.", "Service unavailable. Please check back later.", "The site is temporarily offline. Thank you for your patience.", "JavaScript must be enabled to use this application.", "Enable scripts in your browser and reload this dashboard.",
    "Your browser does not support JavaScript or it is turned off.", "Checking your browser, please wait. Enable cookies to continue.", "Sorry, this report needs JavaScript. Please turn it on.", "Unsupported browser. Please update your browser to continue.", "Request blocked. Too many requests from this address.",
    "Такой страницы нет: она удалена или перемещена.", "Ошибка сервера. Попробуйте обновить страницу позже.", "Извините, сервис недоступен. Мы скоро вернёмся.", "Нет доступа к странице. Обратитесь к администратору.", "Чтобы продолжить, войдите в систему.", "Сессия истекла, авторизуйтесь снова.", "Включите скрипты в браузере, чтобы увидеть отчёт.",
    "Запросов слишком много, повторите попытку через несколько секунд.", "Ведутся технические работы, сайт временно закрыт.", "Ваш браузер не поддерживается, обновите браузер.",
    "Diese Seite gibt es nicht oder sie wurde verschoben.", "Serverfehler. Bitte laden Sie die Seite später neu.", "Kein Zugriff: Sie haben keine Berechtigung für diese Seite.", "Bitte melden Sie sich erneut an, Ihre Sitzung ist beendet.", "Der Dienst ist zurzeit nicht verfügbar, bitte später erneut versuchen.", "Wartungsarbeiten: wir sind bald wieder da.",
    "Bitte schalten Sie JavaScript in Ihrem Browser ein.", "Ihr Browser wird nicht unterstützt, bitte aktualisieren Sie ihn.", '{"status": 503, "error": "Service Unavailable", "message": "try again later"}', "<html><body><h1>Forbidden</h1><p>You do not have permission to access this page.</p></body></html>", "Menu | Search\nThis page could not be found.\nBack to home",
]
FILLER = [
    "The pool was small.\n\nThis text will be replaced later.", "# Cause\nDescription to be added.", "Dummy text for this section.", "Content will follow soon.", "Heading\n\nThis is an example paragraph.", "Lorem ipsum dolor sit.", "Aliqua magna labore et dolore ut enim minim.", "test test test", "Placeholder for the description.", "Section under construction, details coming soon.",
    "Здесь появится текст раздела.", "Заглушка, будет заменена позже.", "Описание будет добавлено позже.", "Пример абзаца для раздела.", "Рыба-текст, заменить.", "Der Text folgt später.", "Platzhalter für die Beschreibung.", "Beispieltext für diesen Abschnitt.", "Blindtext, wird noch ersetzt.", "Die Beschreibung folgt.",
    "Queue was long.\nLorem ipsum dolor\nsit amet consectetur\nadipiscing elit.",
]
MARKS = [
    "Owner: {{ squad }}", "Since {{ first_seen_at }} the pool is full.", "The alert {% now %} fired.", "Board: ${GRAFANA_BOARD}", "Contact <<on call person>> first.", "See [[postmortem link]].", "Stand @@STAGE_NAME@@ was slow.", "Restart __COMPONENT__ now.", "Look at %BOARD_URL% first.", "[insert graph here]", "[TODO: timeline]", "<your team here>", "<enter summary>", "[fill in the impact]",
    "[указать причину]", "<вставить ссылку>", "[заполнить позже]", "[Ursache eintragen]", "<Dienst ergänzen>", "[hier Namen einfügen]", "Cause: {{ }}", "[describe the fix]", "<specify region>", "Der Ausfall von {{ dienst_name }} war kurz.",
]
CONTENT = [
    "The gateway answered 502 for nine minutes because the upstream pool of billing was empty; we doubled it.", "Users reported that the page was not found after the release, as the route table still held the old path.", "Session tokens expired early: the clock of one node ran ahead by four minutes.", "We disabled JavaScript bundles on the status board and measured the load again.",
    "Check the queue length, then restart the drainer on both stands and watch the error rate.", "Maintenance of the database took longer than planned, so orders were late by an hour.", "The template engine printed `{{ owner }}` because the variable was never set in the deploy job.", "Log level [WARN] at 12:01, then <n> retries for <uuid> until the pool recovered.", "| alert | service |\n|---|---|\n| PoolNearLimit | billing |",
    "Доступ к базе был закрыт на две минуты из-за смены пароля, очередь выросла до тысячи.", "После выкатки сервис отвечал с ошибкой, откат помог за пять минут.", "Der Dienst war nach dem Ausrollen nicht erreichbar, weil die Datenbank keine Verbindungen annahm.", "Die Sitzungen liefen zu früh ab, da die Uhr eines Knotens vorging.", "import os\nprint(os.environ['HOME'])", "ERROR [payment-api] ConnectionTimeoutError: timed out after 3000 ms (order 17)",
]
