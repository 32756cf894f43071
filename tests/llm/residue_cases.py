"""Held-out residue and ordinary texts, written from common server software, frameworks and site builders.

They are independent of the rules' word lists and of the given tables: a text is a carrier filled
with one message, so positives and negatives share their surroundings.
"""

from __future__ import annotations

import random

RESIDUE = {
    "failed page": (
        "404 Not Found\nnginx/1.18.0", "403 Forbidden", "502 Bad Gateway", "500 Server Error", "500 Internal Server Error", "HTTP Error 404. The requested resource is not found.", "HTTP Status 404 – Not Found", "Error 404",
        "The requested URL /index.php was not found on this server.", "Not Found\nThe requested URL was not found on this server.", "The page you requested could not be found", "Sorry, the page you are looking for doesn't exist or has been moved.",
        "We can't find the page you're looking for.", "Oops! That page can’t be found.", "This page isn't available right now.", "This site can’t be reached", "The server is temporarily unable to service your request due to maintenance downtime or capacity problems.",
        "Service Temporarily Unavailable", "Error establishing a database connection", "Database connection error", "Fatal error: Uncaught Error: Call to undefined function get_header() in /var/www/html/index.php:12", "Warning: mysqli_connect(): (HY000/2002): Connection refused in /home/site/db.php on line 8",
        "Traceback (most recent call last):\n  File \"app.py\", line 7, in <module>\nImportError: no module named x", "java.lang.NullPointerException: null\n\tat com.acme.Main.run(Main.java:14)", "TypeError: Cannot read properties of undefined (reading 'map')",
        "You don't have permission to access this resource.", "You do not have permission to view this directory or page.", "Access to this page has been denied because we believe you are using automation tools.", "Sorry, you have been blocked", "Please verify you are a human.",
        "Checking your browser before accessing example.", "Too Many Requests", "Your session has timed out. Please log in again.", "Session expired", "An error occurred while processing your request.", "Something went wrong. Please try again later.",
        "This video is unavailable.", "Your connection was interrupted. The connection was reset.", "The connection has timed out", "Page introuvable", "Erreur 404 : la page demandée n'existe pas.", "Accès refusé", "Página no encontrada", "Lo sentimos, la página que busca no existe.",
        "Seite nicht gefunden", "Die angeforderte Seite existiert nicht.", "Zugriff verweigert", "Pagina non trovata", "Accesso negato", "Página não encontrada", "Acesso negado", "Страница не найдена", "Доступ запрещён", "Ошибка 404", "Nie znaleziono strony", "Pagina niet gevonden",
        "Sayfa bulunamadı", "Sidan hittades inte", "页面不存在", "抱歉，您访问的页面找不到了", "ページが見つかりません", "페이지를 찾을 수 없습니다",
    ),
    "script notice": (
        "You need to enable JavaScript to run this app.", "Please enable JavaScript to view the comments powered by Disqus.", "JavaScript is disabled in your browser.", "JavaScript is required to use this site.", "This site requires JavaScript.", "Enable JavaScript and cookies to continue",
        "Please turn on JavaScript in your browser settings and reload the page.", "Your browser does not support the video tag.", "Your browser is not supported. Please upgrade to a modern browser.", "Your browser is out of date.", "You are using an unsupported browser.",
        "JavaScript est désactivé", "Veuillez activer JavaScript dans votre navigateur.", "JavaScript está desactivado.", "Active JavaScript para ver esta página.", "Bitte aktivieren Sie JavaScript in Ihrem Browser.", "JavaScript ist deaktiviert.", "Abilita JavaScript per continuare.",
        "Por favor, ative o JavaScript.", "Включите JavaScript в вашем браузере.", "请启用JavaScript", "JavaScriptを有効にしてください。", "자바스크립트를 활성화해 주세요.",
    ),
    "stand-in": (
        "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.", "Lorem Ipsum", "Your text here", "Add your text here.", "Click here to add text", "Type something here", "Insert text here", "Content goes here.", "Description coming soon.", "TBD", "TODO", "To be announced",
        "This is a sample page. Edit or delete it, then start writing!", "This is placeholder text.", "Enter your title here", "Write a short description here", "Image caption goes here", "Section under construction", "Page under construction", "Votre texte ici", "Escribe tu texto aquí",
        "Ihr Text hier", "Inserisci qui il tuo testo", "Insira seu texto aqui", "Введите текст здесь", "在此输入文字", "ここにテキストを入力してください", "asdf asdf asdf asdf", "Replace this text with your own.", "Tagline to come", "Bio coming soon",
    ),
    "slot": (
        "Dear [FirstName],", "Hello $name$, thanks for your order.", "Dear <<customer_name>>,", "Dear {{first_name}},", "Hi %FIRST_NAME%, welcome.", "Dear [Your Name]", "Hello ${user.name}!", "Welcome, {username}!", "Dear [Customer Name],", "Order #{{order.id}} shipped", "Hello <%= @user.name %>",
        "Dear «First Name»,", "Contact us at [email address]", "Dear [LAST_NAME],", "Published on [[date]]", "Your invoice {invoice_number} is due", "Hello __NAME__", "Copyright @@YEAR@@", "{% include 'footer.html' %}", "Hi *|FNAME|*,",
    ),
}

ORDINARY = (
    "The page turned yellow in the sun and the ink had run.", "We could not find any trace of the older foundations.", "The server brought two plates of soup.", "He was denied access to the archive until the spring, and wrote to the minister.", "Error bars show one standard deviation.",
    "The site was moved to the north bank after the flood of 1802.", "Her request was refused twice.", "The document describes three ways to cut the timber.", "The team wrote the client in JavaScript and the server in Go.", "JavaScript was created in ten days in 1995.", "Cookies are baked for twelve minutes.",
    "A 404 page is what a server sends when nothing is found under an address.", "Designers often fill a layout with “Lorem ipsum dolor sit amet”.", "The phrase \"page not found\" is known to everyone.", "Status codes such as `404 Not Found` belong to the protocol.", "In Jinja, `{{ name }}` prints a variable.",
    "He found the page he was looking for between two others.", "The browser chewed on young shoots.", "The content of the chest was listed by the notary.", "Write the date at the top of the form.", "Add the flour here and there, not all at once.", "The session was opened by the chair.", "Their connection was broken off in 1911.",
    "The set {1, 2, 3} has three members.", "Prices went from $5 to $10 within a year.", "See [12] and [Smith 2004] for the proof.", "If x < y and y > z then swap them.", "The temperature was <10 degrees.", "The text of the treaty was to be written in Latin.", "The bridge was under construction for nine years.", "The summary of the report is on page 4.",
    "The error occurred in the second trial and was corrected by hand.", "To enable trade, the river was deepened.", "Service on the line is no longer daily.", "This file holds the letters of two brothers.", "A file is missing from the box, as the clerk noted in the margin.", "Die Seite des Hauses war mit Efeu bewachsen.", "La page suivante montre une carte.",
    "El sitio fue excavado en 1974.", "Страница была исписана мелким почерком.", "这座桥建于明代。", "寺は山の上にある。", "The limit of the fishery was reached in 1990.", "The access road was closed for repairs.", "Too many requests came in, so the office hired two clerks.", "They verified that he was human.", "Permission was denied by the council.",
    "The database holds forty thousand records.", "The placeholder stone was replaced by marble.", "Something went wrong with the kiln, and the glaze ran.", "Whoever wrote this knew the coast.", "The title of the play is coming from a proverb.", "[sic] marks an error of the source.", "<|im_start|>user", "[CLS] a b [SEP]", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0",
)

CARRIERS = ("{}", "{}\n", "The old mill stands by the river. It was built of oak.\n\n{}\n\nVisitors come in summer.", "Home\nAbout\nContact\n\n{}", "First we rested.\n{}", "{}\n\nThe rest of the account follows in the next letter.")


def cases(seed: int = 5) -> list[tuple[str, bool]]:
    """(text, is residue) of every message in two carriers."""
    rng = random.Random(seed)
    out = []
    for texts, found in ((tuple(x for v in RESIDUE.values() for x in v), True), (ORDINARY, False)):
        for text in texts:
            out += [(carrier.replace("{}", text), found) for carrier in rng.sample(CARRIERS, 2)]
    return out
