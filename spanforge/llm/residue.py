"""Template residue, filler and failed-page text.

Method: every text is cut into messages (lines, then sentences). A fixed-depth prefix tree sorts
them by length and by their first words into leaves; the messages of a leaf that agree in all
words a rule can look at make one template, in which every other word is a wildcard. A template
is classified once, when it is first met, and its verdict holds for all its messages. As rules
see nothing but the words a template keeps, a verdict depends on no other message, tasks need not
exchange their trees to judge, and no text is read twice. Messages without any word that a rule
needs are never put into a tree. Unresolved slots inside ordinary texts are detected separately,
as no template of messages describes them.
Code, inline code and quotations are masked first: they show or discuss such text.
"""

from __future__ import annotations

import re
from http import HTTPStatus

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm._common import worker_cache

DEPTH = 4
TREE_TEMPLATES = 200_000  # a worker's tree is begun anew beyond this; verdicts do not depend on it
WILD, NUMBER, STATUS_CODE = "*", "#", "<status>"
SHOWN = " \x02 "  # stands for masked code and quotations: a word of no vocabulary

_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_INLINE = re.compile(r"`[^`\n]*`")
_QUOTED = re.compile(r"“[^”\n]{0,300}”|„[^“”\n]{0,300}[“”]|«\s[^»\n]{0,300}\s»|(?<![\w=])\"[^\"\n]{0,300}\"(?!\w)|= ?\"[^\"\n]{0,300}\"")
_STOP = re.compile(r"[.!?](?=\s|[A-ZÀ-Þ¿¡])|[。！？]")
_SLOT_CHARS = ("{", "[", "<", "%", "@@", "__", "$", "«", "*|")
_WIDE = re.compile(r"[\u2e80-\uffef]")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+|\x02|\.{3,}|…|\?{3,}|:")
_CODES = frozenset(str(s.value) for s in HTTPStatus if s.value >= 400)

# The words of the usual Latin filler text.
FILLER_WORDS = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore "
    "magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute "
    "irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident "
    "sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
# The words of keyboard filler.
KEYBOARD_WORDS = frozenset("asdf asdfg asdfgh asdfghjkl qwer qwert qwerty qwertz zxcv jkl hjkl foo bar baz bla blah blub xxx yyy zzz abc abcd test testing aaa".split())
# Markers of model vocabularies that look like slots.
VOCABULARY_MARKERS = frozenset("PAD UNK CLS SEP MASK BOS EOS S INST SYS EOT BOM URL NUM".split())

# Slots. A name between strong marks is a slot whatever it is; between marks that ordinary text
# uses too it must be named like a field of a form.
_NAME = r"[A-Za-z_][\w.]*(?:[ -][\w.]+){0,3}"
# What fields of forms are called.
FIELDS = (
    "name|surname|username|date|day|month|year|time|number|id|code|amount|price|total|quantity|address|street|city|state|country|zip|email|phone|url|link|title|subject|heading|"
    "company|organi[sz]ation|customer|client|recipient|sender|user|author|product|order|invoice|reference|department|position|location|event|topic|text|content|description|message|logo|signature|salary|fname|lname"
)
_FIELD = rf"(?:(?i:(?:[a-z]+[ _.-]){{0,3}}(?:{FIELDS}))|[A-Za-z]*[a-z](?:{'|'.join(x.capitalize() for x in FIELDS.split('|') if x.isalpha())}))"
SLOT = re.compile(
    r"\{\{\{?[-#/^>!~]?\s*[\w.|: \[\]'()-]{1,80}\s*\}?\}\}"
    r"|\{%-?\s*[a-z]\w*\b[^%\n]{0,120}%\}"
    r"|<%[=#@-]?\s*@?[\w.]+[^%\n]{0,80}%>"
    r"|\$\{\s*" + _NAME + r"\s*\}"
    r"|\$\(\s*" + _NAME + r"\s*\)"
    r"|#\{\s*" + _NAME + r"\s*\}"
    r"|\[\[\s*" + _NAME + r"\s*\]\]"
    r"|%%\s*" + _NAME + r"\s*%%"
    r"|(?<![\w%])%[A-Z][A-Z0-9_]{2,}%(?![\w%])"
    r"|@@\s*" + _NAME + r"\s*@@"
    r"|\*\|[A-Z][A-Z0-9_:]*\|\*"
    r"|(?<![A-Za-z0-9_])__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?![A-Za-z0-9_])"
    r"|(?<![\w$#{])\{(?:[A-Za-z_][\w.]*|\d)\}(?!\})"
    r"|«\s?[A-Za-z][A-Za-z_.]*(?: [A-Za-z0-9]+){0,3}\s?»"
    r"|<<\s*(?:" + _FIELD + r"|[a-z]+(?:_[a-z0-9]+)+)\s*>>"
    r"|(?<![\w$])\$" + _FIELD + r"\$(?![\w$])"
    r"|<(?P<mark>[A-Z][A-Z0-9_]+)>"
    r"|(?<![\w\]])\[" + _FIELD + r"\](?![\w(\[:])"
    r"|\[(?:(?i:insert|enter|add|put|type|your)\b[^\]\n]{0,60}|[^\]\[\n]{1,60}\b(?i:goes here|to be (?:added|inserted|filled(?: in)?)|placeholder))\]"
)

# The rules' words. A name in braces stands for any phrase of its line; "_" joins the words of a phrase.
WORDS = {
    "DET": "the this that your our a an any some le la les l ce cette cet votre notre el los las esta este su nuestra die der das diese dieser dieses ihre ihr il lo questa questo tua tuo il_tuo la_tua o os as deze dit het de den det эта этот эту bu",
    "ADJ": "requested web desired specified following angeforderte gewünschte angegebene solicitada solicitado demandée richiesta requested_web opgevraagde",
    "PLACE": "page webpage site website document resource url file viewer article content address link item record image video photo host domain endpoint route application app service server request database gateway location product listing directory "
    "ressource fichier contenu serveur adresse página pagina sitio sito recurso risorsa documento archivo arquivo ficheiro artículo artigo articolo contenido conteúdo contenuto servidor servicio serviço servizio "
    "seite webseite internetseite website datei artikel inhalt dokument dienst bestand страница страницу страницы сайт файл документ ресурс сервер strona strony strony_internetowej plik pliku sidan sida filen sayfa dosya side siden",
    "WEBPLACE": "page webpage site website url resource página pagina seite webseite link",
    "REL": "you_asked_for you_requested you_have_requested you_are_requesting you_are_looking_for you're_looking_for you_were_looking_for you_wanted you_tried_to_reach you_tried_to_open you_are_trying_to_reach you_are_trying_to_access that_you_requested that_you_asked_for that_you_are_looking_for you_searched_for you_want "
    "que_vous_cherchez que_vous_recherchez que_vous_avez_demandée demandée demandé recherchée que_busca que_buscas solicitada solicitado die_sie_suchen angeforderte richiesta richiesto cercata che_cerchi que_procura que_você_procura",
    "NOT": "not was_not wasn't were_not is_not isn't are_not could_not could_not_be couldn't couldn't_be cannot cannot_be can_not can_not_be can't can't_be can’t_be does_not doesn't doesn’t do_not did_not no_longer is_no_longer has_not_been is_currently_not is_not_currently wasn’t isn’t couldn’t_be can’t",
    "SEEN": "found exist exists available reached reachable displayed loaded opened located shown accessed accessible served retrieved",
    "BEEN": "was has_been is were may_have_been might_have_been may_be or_has_been had_been has",
    "GONE": "moved deleted removed archived expired renamed missing gone",
    "ABSENT": "introuvable introuvables est_introuvable non_trouvé non_trouvée non_trouvés inexistant inexistante n'existe_pas n’existe_pas n'existe_plus n'a_pas_été_trouvée n'est_pas_disponible a_été_supprimée "
    "no_encontrada no_encontrado no_existe no_se_encuentra no_se_encontró no_se_ha_encontrado no_fue_encontrada no_disponible no_está_disponible nicht_gefunden wurde_nicht_gefunden konnte_nicht_gefunden_werden existiert_nicht nicht_verfügbar ist_nicht_verfügbar nicht_vorhanden "
    "non_trovata non_trovato non_esiste non_disponibile non_è_disponibile non_è_stata_trovata não_encontrada não_encontrado não_existe não_foi_encontrada não_disponível indisponível niet_gevonden bestaat_niet niet_beschikbaar "
    "не_найдена не_найден не_найдено не_существует недоступна недоступен nie_istnieje nie_została_znaleziona bulunamadı mevcut_değil hittades_inte finns_inte ikke_fundet findes_ikke ikke_funnet",
    "SEEK": "nie_znaleziono no_such we_can't_find we_can’t_find we_cannot_find we_could_not_find we_couldn't_find we_couldn’t_find sorry_we_can't_find sorry_we_could_not_find we_are_unable_to_find unable_to_find unable_to_locate unable_to_load failed_to_load could_not_load cannot_find can't_find couldn't_find cannot_display",
    "HTTP": "http https status code error err erreur fehler errore erro ошибка błąd fout fel hata hiba",
    "FAULT": "bad_request unauthorized unauthorised authorization_required payment_required forbidden not_found page_not_found file_not_found resource_not_found method_not_allowed not_acceptable request_timeout request_time_out conflict gone "
    "too_many_requests internal_error internal_server_error server_error not_implemented bad_gateway service_unavailable service_temporarily_unavailable temporarily_unavailable gateway_timeout gateway_time_out access_denied unknown_error database_error interno interne inattendue inesperado",
    "DENIED": "access_denied access_is_denied access_was_denied access_forbidden access_restricted access_blocked permission_denied request_blocked accès_refusé accès_interdit accès_non_autorisé accès_restreint acceso_denegado acceso_prohibido acceso_no_autorizado acceso_restringido "
    "zugriff_verweigert zugriff_nicht_erlaubt zugang_verweigert zugang_verboten zugriff_verboten accesso_negato accesso_non_autorizzato accesso_vietato acesso_negado acesso_proibido acesso_não_autorizado toegang_geweigerd toegang_verboden доступ_запрещен доступ_запрещён доступ_закрыт в_доступе_отказано odmowa_dostępu brak_dostępu erişim_engellendi åtkomst_nekad adgang_nægtet",
    "YOUCANT": "you_do_not_have you_don't_have you_don’t_have you_need you_lack",
    "RIGHT": "permission permissions access authorization",
    "OUT": "unavailable down offline under_maintenance not_available no_longer_available unreachable not_reachable unable_to_service overloaded out_of_service not_responding",
    "ADV": "temporarily currently no_longer permanently now right_now down_for",
    "LINK": "connection connexion conexión verbindung connessione conexão",
    "BROKEN": "timed_out refused reset lost interrupted failed was_interrupted was_reset was_refused has_timed_out is_not_private is_not_secure error échouée rechazada fehlgeschlagen unterbrochen rifiutata recusada",
    "SORRY": "sorry oops oh_no uh_oh whoops ouch we're_sorry we_are_sorry we’re_sorry lo_sentimos désolé désolée nous_sommes_désolés leider entschuldigung spiacenti ci_dispiace desculpe извините",
    "OOPS": "oops oh_no uh_oh whoops ouch",
    "WENTWRONG": "something_went_wrong did_not_work didn't_work didn’t_work hit_a_snag went_wrong something_broke broke error problem not_found can't_find can’t_find can’t_be_found cannot_find could_not couldn't couldn’t_find unavailable failed does_not_exist doesn't_exist doesn’t_exist no_existe n'existe_pas blocked have_been_blocked isn't_available",
    "OCCURRED": "an_error_occurred an_error_has_occurred an_unexpected_error_occurred an_unexpected_error_has_occurred an_unknown_error_occurred an_internal_error_occurred an_internal_error_has_occurred an_error_was_encountered that_did_not_work we_hit_a_snag unexpected_error_occurred "
    "une_erreur_est_survenue une_erreur_s'est_produite une_erreur_inattendue ha_ocurrido_un_error se_ha_producido_un_error se_produjo_un_error ocurrió_un_error ein_fehler_ist_aufgetreten es_ist_ein_fehler_aufgetreten si_è_verificato_un_errore ocorreu_um_erro произошла_ошибка er_is_een_fout_opgetreden wystąpił_błąd bir_hata_oluştu ett_fel_uppstod ett_fel_har_uppstått",
    "SESSION": "session sesión sitzung sessione sessão сессия сеанс sessie sesja oturum",
    "OVER": "expired has_expired timed_out has_timed_out expirée a_expiré expirado ha_expirado caducado ha_caducado abgelaufen ist_abgelaufen scaduta è_scaduta expirou истекла истёк verlopen wygasła",
    "LOGIN": "sign_in_to log_in_to login_to please_sign_in_to please_log_in_to please_login_to you_must_be_logged_in you_must_log_in you_need_to_log_in please_log_in please_sign_in veuillez_vous_connecter inicie_sesión bitte_melden_sie_sich accedi_per faça_login войдите_чтобы",
    "GOON": "continue view see access proceed pour para um per",
    "HUMAN": "checking_your_browser checking_if_the_site_connection_is_secure verify_you_are_human verify_you_are_a_human verify_that_you_are_human verifying_you_are_human verify_that_you_are_a_human please_verify_you_are_a_human please_verify_you_are_human please_verify_that_you_are_human confirm_you_are_human are_you_a_robot complete_the_check complete_the_captcha complete_the_challenge complete_the_security_check just_a_moment attention_required",
    "LIMIT": "rate_limit request_limit usage_limit download_limit daily_limit quota too_many_requests slow_down api_limit",
    "REACHED": "reached exceeded",
    "SCRIPT": "javascript java_script js script scripts scripting client_side_script client_side_scripts client_side_scripting scripting_support javascripts skripte jscript cookies cookie явaскрипт",
    "ENABLE": "enable activate turn_on allow switch_on unblock re_enable activer activez autoriser autorisez réactivez activa active activar habilite habilita habilitar permita aktivieren aktivieren_sie erlauben erlauben_sie schalten_sie einschalten abilita abilitare abilitate attiva attivare attivate ative ativar habilite включите включить разрешите włącz schakel etkinleştirin aktivera aktiver",
    "PLEASE": "please kindly you_need_to you_must you_have_to you_need must you_should to veuillez merci_d' merci_de pour por_favor debe debe_activar debes bitte sie_müssen per_favore si_prega_di devi пожалуйста proszę lütfen vänligen you’ll_need_to you'll_need_to",
    "NEEDS": "needs need requires require relies_on must_have does_not_work_without doesn't_work_without cannot_run_without can't_run_without will_not_work_without won't_work_without does_not_work cannot can't can_not will_not won't does_not doesn't do_not "
    "nécessite requiert requiere necesita benötigt erfordert braucht richiede requer exige necessita требует wymaga vereist gerektirir kräver",
    "ISOFF": "disabled is_disabled is_off is_turned_off is_not_enabled not_enabled isn't_enabled is_required are_required required must_be_enabled must_be_on seems_to_be_disabled appears_to_be_disabled has_been_disabled is_blocked are_disabled is_needed must needs has_to_be is_unavailable is_currently_disabled "
    "désactivé est_désactivé est_requis requis desactivado está_desactivado deshabilitado está_deshabilitado deaktiviert ist_deaktiviert ist_erforderlich disabilitato è_disabilitato disattivato è_disattivato desativado está_desativado отключен отключён выключен wyłączony uitgeschakeld is_uitgeschakeld",
    "BROWSER": "your_browser this_browser the_browser browser votre_navigateur navigateur su_navegador tu_navegador navegador ihr_browser il_tuo_browser seu_navegador ваш_браузер браузер",
    "OLD": "is_not_supported isn't_supported is_too_old is_outdated is_out_of_date is_no_longer_supported is_unsupported is_blocking blocks does_not_support doesn't_support doesn’t_support does_not_allow doesn't_allow must needs is_not_compatible "
    "n'est_pas_pris_en_charge n'est_plus_pris_en_charge est_obsolète est_trop_ancien bloque no_es_compatible está_obsoleto está_desactualizado es_antiguo bloquea wird_nicht_unterstützt ist_veraltet ist_zu_alt blockiert non_è_supportato è_obsoleto não_é_suportado está_desatualizado не_поддерживается устарел",
    "NEWER": "upgrade update switch use_a_newer use_a_different use_a_modern change",
    "THING": "abstract answer answers article author bio biography body bullet caption chapter company contact content copy description details detail document headline heading image info information intro introduction item items label name note owner page paragraph photo price query section subheading subtitle summary tagline team text texts title value",
    "INFO": "text title summary description content heading headline subtitle caption paragraph name copy abstract intro introduction details quote bio tagline something",
    "PUT": "insert add put enter type write replace paste click_here_to_add click_to_add click_to_edit click_here_to_edit",
    "LATER": "tbd tba tbc coming_soon to_follow to_come pending missing placeholder ... … ??? n_a_yet lorem_ipsum under_construction not_yet_written to_be_written to_be_supplied to_be_added to_be_announced to_be_defined to_be_determined to_be_completed to_be_filled to_be_filled_in to_be_provided to_be_done to_be_inserted to_be_decided to_be_confirmed to_be_continued "
    "be_written be_supplied be_added be_announced be_completed be_provided",
    "TODO": "todo tbd tbc tba fixme xxx",
    "BE": "is are will still yet",
    "OWN": "texte texto text inhalt titre título titel contenu contenido conteúdo testo titolo contenuto текст заголовок tekst metin",
    "FILL": "saisissez insérez écrivez remplacez ajoutez entrez votre escriba escribe inserte inserta introduzca introduce ponga añada agregue reemplace sustituya su tu ihr ihren dein deinen geben_sie fügen_sie inserisci inserire aggiungi scrivi il_tuo insira digite escreva adicione seu o_seu введите вставьте добавьте ваш voer wpisz twój",
    "HERE": "ici aquí aqui hier qui здесь tutaj",
}
# Rules on the start of a template. "~n": up to n words of any kind; "?": may be missing; "+": several; "|": either; "$": the message ends.
RULES = (
    ("stand-in", "your|the|my|insert|add|put|enter|type|write ~6 goes|go|comes|{THING} here"), ("stand-in", "your {INFO} here ~2 $"), ("stand-in", "~1 {THING} goes|go|comes here ~3 $"), ("stand-in", "this is a sample page|post|text|paragraph $"), ("stand-in", "edit or delete it|this|them ~6 $"),
    ("stand-in", "{PUT} ~1 your|this|the|some ~8 here|with_your_own|with_real|with_actual|with_final ~4 $"), ("stand-in", "{PUT} ~1 {INFO} here ~4 $"), ("stand-in", "{PUT} your|a ~2 {INFO} here ~2 $"),
    ("stand-in", "replace this|the|these ~8 with|by"), ("stand-in", "click_here_to_add|click_to_add|click_to_edit|click_here_to_edit ~4 $"),
    ("stand-in", "this|here is a|an|some|the|just? a? placeholder|dummy|filler|stand_in"), ("stand-in", "this|here is a|an|some|the|just? sample|mock|example ~2 {THING} ~6 replace|write|edit|change|delete"),
    ("stand-in", "{TODO} $"), ("stand-in", "{TODO} :"), ("stand-in", "{TODO} write|add|insert|fill|replace|complete|describe|finish|update"), ("stand-in", "to_be_announced|to_be_determined|to_be_written|to_be_supplied|to_be_added|to_be_continued|coming_soon|under_construction|content_coming_soon $"),
    ("stand-in", "{THING} #? *? :? *? :? {BE}? {BE}? {LATER} ~1 $"), ("stand-in", "more|real|final? {THING} coming_soon|to_come|to_follow|to_be_written|to_be_supplied|to_be_added|to_be_announced ~4 $"), ("stand-in", "*|# *? :? ...|… $"),
    ("stand-in", "{FILL} ~3 {OWN} ~2 $"), ("stand-in", "{FILL} {HERE} ~3 {OWN} ~2 $"), ("stand-in", "{OWN} {HERE}|à_remplacer|à_compléter|de_remplissage|de_remplacement|provisoire|de_relleno|provisional|pendiente|folgt|einfügen|segnaposto|provvisorio|provisório"),
    ("stand-in", "contenu_à_venir|contenido_pendiente|próximamente|platzhalter|blindtext|mustertext|beispieltext|inhalt_folgt|segnaposto|em_breve|prossimamente|скоро_будет ~1 $"), ("stand-in", "hier steht|kommt|folgt|entsteht ~5 {OWN}"),
    ("failed page", "{HTTP}? {HTTP}? :? {STATUS} ~1 :? {FAULT}|{DENIED} ~6 $"), ("failed page", "{HTTP} {HTTP}? :? #? :? {FAULT} ~6 $"), ("failed page", "{HTTP} {HTTP}? :? {STATUS} $"), ("failed page", "{HTTP} {HTTP}? :? {STATUS} : ~12 $"), ("failed page", "{HTTP} {STATUS} {DET}? {ADJ}? {PLACE} ~8 $"),
    ("failed page", "{STATUS} :? {HTTP}? :? {DET}? {ADJ}? {PLACE} {NOT} {SEEN} ~3 $"), ("failed page", "{STATUS} :? {PLACE} {ABSENT} ~2 $"), ("failed page", "{FAULT} $"),
    ("failed page", "{DET}? {ADJ}? {PLACE} {REL}? {NOT} ~1 {SEEN} ~3 on_this_server? $"), ("failed page", "{DET}? {ADJ}? {PLACE} *? {NOT} {SEEN} on_this_server"), ("failed page", "{DET}? {ADJ}? url ~4 {NOT} {SEEN} on_this_server ~2 $"), ("failed page", "{DET}? {ADJ}? {PLACE} {REL}? {NOT} {SEEN} or ~8 {GONE} ~3 $"),
    ("failed page", "{DET}? {ADJ}? {PLACE} {REL}? {BEEN} ~1 {GONE} ~4 $"), ("failed page", "{SORRY} ~2 {PLACE} {REL} {NOT} ~8 $"), ("failed page", "{DET}? {ADJ}? * {REL}? {NOT} {SEEN} $"),
    ("failed page", "{DET}? {ADJ}? {PLACE} {REL}? ~1 {ABSENT} ~3 $"), ("failed page", "{HTTP} {STATUS} :? {DET}? {PLACE} {REL}? {ABSENT} ~3 $"), ("failed page", "{SORRY} ~1 {DET}? {PLACE} ~4 {ABSENT} ~3 $"),
    ("failed page", "{SEEK} {DET}? ~1 {WEBPLACE}|strony|file ~8 $"), ("failed page", "{DENIED} ~1 $"), ("failed page", "{YOUCANT} {RIGHT} ~10 $"), ("failed page", "access to this|the {PLACE} is|was|has_been|has denied|blocked|restricted|forbidden|been_denied ~9 $"), ("failed page", "you_are_not|you_are_not_currently authorized|authorised|allowed to view|access|see ~6 $"), ("failed page", "{SORRY}? you have been blocked ~6 $"),
    ("failed page", "{DET}? {PLACE} is|are {ADV}? {OUT} ~14 $"), ("failed page", "{DET} {PLACE} isn't|isn’t|is_not available|reachable|responding ~9 $"), ("failed page", "service {ADV}? unavailable ~6 $"), ("failed page", "service temporairement? indisponible"), ("failed page", "servicio_no_disponible|dienst_nicht_verfügbar|dienst_nicht_erreichbar|servizio_non_disponibile"),
    ("failed page", "error|erreur|error_al|fehler establishing|connecting ~1 a|the? database ~2 $"), ("failed page", "error establishing ~3 connection ~2 $"), ("failed page", "{DET}? *? database? {LINK} {BROKEN} ~6 $"), ("failed page", "unable_to_connect|could_not_connect|cannot_connect|failed_to_connect ~6 $"),
    ("failed page", "{SORRY} ~6 {WENTWRONG}"), ("failed page", "{OOPS} $"), ("failed page", "sorry $"), ("failed page", "{OCCURRED} ~12 $"), ("failed page", "something_went_wrong|something_broke on|at? our? end|side? $"), ("failed page", "something_went_wrong|something_broke :? please|try|while|when|and_we|we|here ~12 $"), ("failed page", "error|fehler|erreur|errore|erro|ошибка interno|interne|inattendue|inesperado|intern|interner ~5 $"), ("failed page", "interner fehler|serverfehler ~5 $"),
    ("failed page", "{DET}? {SESSION} {OVER} ~6 $"), ("failed page", "{LOGIN} {GOON} ~6 $"), ("failed page", "you_must_be_logged_in|you_must_log_in|you_need_to_log_in|veuillez_vous_connecter|inicie_sesión|bitte_melden_sie_sich|войдите_чтобы ~6 $"), ("failed page", "{HUMAN} ~8 $"), ("failed page", "*? {LIMIT} {REACHED} ~5 $"), ("failed page", "too_many_requests|slow_down|quota_exceeded ~4 $"),
    ("script notice", "{PLEASE}? {PLEASE}? {ENABLE} ~3 {SCRIPT} ~14 $"), ("script notice", "{PLEASE} ~6 {ENABLE} ~2 {SCRIPT} ~12 $"), ("script notice", "{DET}? {DET}? {PLACE}|*|viewer ~3 {NEEDS} ~5 {SCRIPT} ~8 $"), ("script notice", "{NEEDS} ~5 {SCRIPT} ~8 $"), ("script notice", "{SCRIPT} and? {SCRIPT}? {ISOFF} ~10 $"),
    ("script notice", "~4 nécessite|requiert|requiere|necesita|benötigt|erfordert|braucht|richiede|requer|требует|wymaga|vereist|kräver ~2 {SCRIPT}"),
    ("script notice", "{BROWSER} {OLD}"), ("script notice", "{BROWSER} has ~7 disabled"), ("script notice", "{BROWSER} ~3 bloque|bloquea|blockiert|obsolète|obsoleto|antiguo|veraltet|устарел"), ("script notice", "please? {NEWER} your|to? a? newer|modern|different|supported? browser|browsers ~10 $"), ("script notice", "unsupported browser ~1 $"), ("script notice", "you_are_using|you're_using an|a unsupported|outdated|old|obsolete browser ~8"),
)
# Rules for scripts that do not part words by blanks, and for the raw form of traces and tags.
WIDE_RULES = (
    ("stand-in", r"在(?:此|这里|此处)(?:处)?(?:输入|填写|插入|添加|编写)|此处(?:填写|输入|插入|为占位|放置|是)|(?:请|請)(?:输入|輸入|填写|填寫)(?:您的|你的)?(?:文字|文本|内容|內容|标题|摘要|正文)|占位(?:文本|文字|内容|符)|示例(?:文本|文字|段落)|(?:内容|內容|正文|文字)(?:待补充|待补|待定|待填|稍后|即将)|待补充|敬请期待|敬請期待"),
    ("stand-in", r"ここに.{0,20}(?:入力|記入|挿入|入り|書|記載|テキスト|本文|文章)|(?:ダミー|サンプル|仮の?)(?:テキスト|文章|本文)|本文(?:は後|を入力|準備中)|準備中|近日公開|文章が入ります|여기에.{0,12}(?:입력|작성)|내용을 입력|준비 ?중입니다"),
    ("failed page", r"(?:页面|頁面|网页|网站|文件|资源|文档|内容)(?:不存在|未找到|找不到|无法(?:找到|访问|显示|打开))|找不到(?:该|此|您|请求|所|这个)?.{0,8}(?:页面|网页|文件|资源|文档)|(?:访问|存取)(?:被拒绝|被拒|受限|遭拒)|拒绝访问|无权(?:限)?访问|没有权限|服务器(?:内部)?(?:错误|出错|繁忙|无响应)|内部(?:服务器)?错误|(?:服务|服務)(?:暂时)?不可用|出错了|(?:网关|请求)超时|会话已(?:过期|超时)|请(?:重新)?登录后"),
    ("failed page", r"(?:ページ|ファイル|文書|リソース|コンテンツ)(?:が|は)?(?:見つかりません|存在しません|表示できません|利用できません)|見つかりませんでした|アクセス(?:が|は)?(?:拒否|できません|制限)|(?:サーバー|サーバ|内部)(?:内部)?エラー|エラーが発生|サービス(?:は|を)?(?:利用できません|一時停止)|セッション(?:が|の)?(?:切れ|期限|有効)|ログインしてください"),
    ("failed page", r"(?:페이지|파일|문서)를? ?찾을 수 없|접근이 ?(?:거부|금지)|액세스가 ?거부|오류가 ?발생|로그인이? ?필요"),
    ("script notice", r"(?:启用|啟用|开启|打开|允许|使用|支持).{0,6}(?:java ?script|js|脚本|cookies?).{0,12}|(?:java ?script|脚本).{0,6}(?:已禁用|被禁用|已关闭|未启用)|浏览器.{0,6}(?:不支持|不受支持|版本过低|过旧|已过时)"),
    ("script notice", r"(?:java ?script|スクリプト|cookie|クッキー).{0,4}を?(?:有効|オン|許可|必要)|(?:java ?script|スクリプト)が(?:無効|必要|オフ)|ブラウザ.{0,10}(?:対応していません|サポートされていません|古)|(?:java ?script|자바스크립트).{0,4}(?:활성화|사용|켜|허용)|브라우저.{0,12}지원(?:하지|되지)"),
)
RAW_RULES = (
    ("failed page", r"traceback \(most recent call last\)"),
    ("failed page", r"exception in thread\b|caused by: [\w.]+(?:exception|error)|uncaught \w*error|unhandled (?:exception|rejection|promise)|(?:php )?(?:fatal|parse|syntax) error: |(?:php )?warning:\s+\w+\(\)|panic: |segmentation fault|(?:[\w.]+\.)?[a-z]\w*(?:error|exception)(?: \[\w+\])?: "),
    ("failed page", r"at [\w.$<>]+\([\w.$ ]+\.\w+(?::\S+)?\)$|file (?:\S+|\s*\x02\s*), line \d+"),
    ("script notice", r"<noscript>"),
)

def _alternatives(element: str) -> list[str]:
    out = []
    for part in element.split("|"):
        name = part.strip("{}")
        out += WORDS[name].split() if part != name and name in WORDS else [part]
    return out


def _phrase(p: str) -> str:
    if p == "{STATUS}":
        return re.escape(STATUS_CODE) + " "
    return "".join(re.escape(w) + " " for w in p.replace("’", "'").split("_")) if p not in ("...", "…") else "(?:\\.{3,}|…) "


def _compile(rule: str) -> tuple[re.Pattern, list[list[str]]]:
    """The regular expression of a rule over a template's words, and the phrases of its needed elements."""
    out, needed = "", []
    for element in rule.split():
        if element == "$":
            out += r"\Z"
        elif element[0] == "~":
            out += rf"(?:\S+ ){{0,{element[1:]}}}?"
        else:
            optional = element.endswith("?") and element != "?"
            phrases = _alternatives(element.removesuffix("?") if optional and not element.endswith("???") else element)
            body = "|".join(sorted({_phrase(p) for p in phrases}, key=len, reverse=True))
            out += f"(?:{body})" + ("?" if optional else "")
            if not optional:
                needed.append(phrases)
    return re.compile(out), needed


def _words(phrases) -> set[str]:
    return {w for p in phrases for w in p.replace("’", "'").split("_")} - {"{STATUS}", WILD, NUMBER, ""}


_RULES = tuple((reason, *_compile(rule)) for reason, rule in RULES)
_WIDE_RULES = tuple((reason, re.compile(rule, re.I)) for reason, rule in WIDE_RULES)
_RAW_RULES = tuple((reason, re.compile(rule, re.I)) for reason, rule in RAW_RULES)
_RAW_HINT = re.compile(r"traceback|rror|xception|anic: |arning:|egmentation|unhandled|noscript|^at |, line \d|TRACEBACK|ERROR", re.M)
VOCABULARY = frozenset(FILLER_WORDS | KEYBOARD_WORDS | {w for v in WORDS.values() for w in _words(v.split())} | {w for _, rule in RULES for e in rule.split() if e[0] != "~" for w in _words(_alternatives(e.removesuffix("?")))})
# Words too common to begin with: a message is put into the tree if it holds another word of the vocabulary that some rule needs.
_COMMON = frozenset(
    "the this that your our a an any some le la les l ce el los las su die der das il lo o os as de den det to is are was were has have had been be may might not no can could do does did will would should must need needs "
    "you we it he at in on of for and or with by from page site document file content title name value item items note label image photo team company article section summary body copy chapter information details answer answers "
    "author price query paragraph time code status address link record service server request video product location something now right see use using change update switch view over own real more final my still yet "
    "ad ex ea ut et id est non eu in sed do test us up so if but que para per um pour por con seite artikel una un es ein ist es_ist si è und y e i en va ha er sie ihr ihre bar elit".split()
)
ANCHORS = frozenset(VOCABULARY - _COMMON) | frozenset(("here", "...", "…", "???")) | _CODES


def mask_shown(text: str) -> str:
    """The text without code, inline code and quotations."""
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    if "`" in text:
        text = _INLINE.sub(SHOWN, text)
    if "“" in text or '"' in text or "„" in text or "« " in text:
        text = _QUOTED.sub(SHOWN, text)
    return text


def has_slot(masked: str) -> bool:
    if not any(c in masked for c in _SLOT_CHARS):
        return False
    return any(m.group("mark") is None or m.group("mark") not in VOCABULARY_MARKERS for m in SLOT.finditer(masked))


def messages(masked: str) -> list[str]:
    """Lines, then sentences."""
    return _STOP.sub(r"\g<0>\n", masked).splitlines()


def _kept(token: str) -> str:
    if token in VOCABULARY or token == ":":
        return token
    if token.isdigit():
        return STATUS_CODE if token in _CODES else NUMBER
    return "…" if token[0] in ".…" else "???" if token[0] == "?" else WILD


def template_of(message: str) -> tuple[str, ...]:
    """The message's words that rules can look at; the others are wildcards."""
    return tuple(map(_kept, _TOKEN.findall(message.lower().replace("’", "'"))))


def classify_template(template: tuple[str, ...]) -> str | None:
    """The verdict on all messages of a template: stand-in, filler, failed page, script notice or None."""
    words = [w for w in template if w not in (NUMBER, STATUS_CODE, ":", "…", "???")]
    most = max(sum(w in FILLER_WORDS for w in words), sum(w in KEYBOARD_WORDS for w in words)) if words else 0
    if most >= 0.7 * len(words) and (len(words) >= 4 or words[:2] == ["lorem", "ipsum"]):
        return "filler"
    line = " ".join(template) + " "
    for reason, rule, _ in _RULES:
        if rule.match(line):
            return reason
    return None


class Tree:
    """Fixed-depth prefix tree: length, then the first words, then the leaf's templates, each with its verdict and count."""

    def __init__(self, depth: int = DEPTH, most: int | None = TREE_TEMPLATES):
        self.depth, self.most, self.leaves, self.size = depth, most, {}, 0

    def add(self, template: tuple[str, ...]) -> str | None:
        """Counts a message and returns its template's verdict."""
        if self.most and self.size >= self.most:
            self.leaves, self.size = {}, 0
        leaf = self.leaves.setdefault((len(template), *template[: self.depth]), {})
        known = leaf.get(template[self.depth :])
        if known is None:
            known = leaf[template[self.depth :]] = [0, classify_template(template)]
            self.size += 1
        known[0] += 1
        return known[1]


def _wide(message: str) -> str | None:
    return next((reason for reason, rule in _WIDE_RULES if rule.search(message)), None)


def _raw(message: str) -> str | None:
    line = message.lstrip(" \t-*#>•|")
    return next((reason for reason, rule in _RAW_RULES if rule.match(line)), None)


def reasons_of(masked: str, tree: Tree):
    """The verdicts on the messages of a masked text."""
    wide, raw = _WIDE.search(masked) is not None, _RAW_HINT.search(masked) is not None
    for message in messages(masked):
        found = _TOKEN.findall(message.lower().replace("’", "'"))
        if not ANCHORS.isdisjoint(found):
            yield tree.add(tuple(map(_kept, found)))
        if raw:
            yield _raw(message)
        if wide and _WIDE.search(message):
            yield _wide(message)


def reason_of(text: str, tree: Tree | None = None) -> str | None:
    """slot, or the first of failed page, filler, script notice, stand-in, or None."""
    masked = mask_shown(text)
    if has_slot(masked):
        return "slot"
    found = set(reasons_of(masked, tree or Tree())) - {None}
    return min(found) if found else None


def classify(message: str) -> str | None:
    """The verdict on one message."""
    return min(set(reasons_of(message, Tree())) - {None}, default=None)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0)


def mine_templates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """(leaf, template, messages, verdict): the templates of all messages that hold a word some rule needs.

    Tasks emit one row per template of their tree, however often its messages occur; the counts
    are added by a group-by. Null and empty texts have no messages.
    """

    def grow(batches):
        tree = Tree(depth, None)  # its counts are emitted before it begins anew

        def rows(tree):
            items = [(f"{path[0]} {' '.join(path[1:])}", " ".join(path[1:] + rest), n, verdict) for path, leaf in tree.leaves.items() for rest, (n, verdict) in leaf.items()]
            for at in range(0, len(items), 20_000):
                leaf, template, n, verdict = zip(*items[at : at + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(template), pa.array(n, pa.int64()), pa.array(verdict, pa.string())], names=["leaf", "template", "messages", "verdict"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for _ in reasons_of(mask_shown(text), tree):
                    pass
                if tree.size >= TREE_TEMPLATES:
                    yield from rows(tree)
                    tree = Tree(depth, None)
        yield from rows(tree)

    grown = _texts(df, id_col, text_col).select("text").mapInArrow(grow, "leaf string, template string, messages bigint, verdict string")
    return grown.groupBy("leaf", "template", "verdict").agg(F.sum("messages").alias("messages")).select("leaf", "template", "messages", "verdict")


def find_residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """(doc, reason): each text with an unresolved slot or a condemned message.

    reason is the first of slot, failed page, filler, script notice, stand-in. Null, empty and
    blank texts are never found; repeated rows give repeated rows; null ids stay null. One pass
    over the texts without a shuffle: a template's verdict is the same in every task.
    """
    texts = _texts(df, id_col, text_col)
    kind = texts.schema["doc"].dataType.simpleString()

    def judge(batches):
        tree = worker_cache(("residue", depth), lambda: Tree(depth))
        for batch in batches:
            take, reasons = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                reason = reason_of(text, tree)
                if reason:
                    take.append(i)
                    reasons.append(reason)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int32())), pa.array(reasons, pa.string())], names=["doc", "reason"])

    return texts.mapInArrow(judge, f"doc {kind}, reason string")


def exclude_residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """The rows of df, all columns kept, whose id is not found; rows with a null id are kept."""
    found = find_residue(df, id_col, text_col, depth).select(F.col("doc").alias("__found_id")).distinct()
    return df.join(found, df[id_col] == F.col("__found_id"), "left_anti")
