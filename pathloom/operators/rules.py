"""Rule tables of the classifiers. A caller may pass its own DataFrame of the same shape instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Packages of the servlet interfaces.
SERVLET_PACKAGES = ("javax.servlet", "jakarta.servlet", "javax.servlet.http", "jakarta.servlet.http")

# Annotated parameters that are external input.
SPRING_WEB = "org.springframework.web.bind.annotation"
INPUT_ANNOTATIONS = {
    (SPRING_WEB,): {
        "RequestParam": "SPRING_REQUEST_PARAM", "PathVariable": "SPRING_PATH_VARIABLE", "RequestHeader": "SPRING_REQUEST_HEADER",
        "CookieValue": "SPRING_COOKIE_VALUE", "RequestBody": "SPRING_REQUEST_BODY", "ModelAttribute": "SPRING_MODEL_ATTRIBUTE"},
    ("javax.ws.rs", "jakarta.ws.rs"): {
        "QueryParam": "JAXRS_QUERY_PARAM", "PathParam": "JAXRS_PATH_PARAM", "HeaderParam": "JAXRS_HEADER_PARAM",
        "CookieParam": "JAXRS_COOKIE_PARAM", "FormParam": "JAXRS_FORM_PARAM", "BeanParam": "JAXRS_BEAN_PARAM"},
}
# Request accessors that are external input.
SERVLET_REQUESTS = (
    "javax.servlet.ServletRequest", "jakarta.servlet.ServletRequest", "javax.servlet.http.HttpServletRequest", "jakarta.servlet.http.HttpServletRequest")
SERVLET_ACCESSORS = {
    "getParameter": "SERVLET_PARAMETER", "getParameterValues": "SERVLET_PARAMETER_VALUES", "getParameterMap": "SERVLET_PARAMETER_MAP",
    "getHeader": "SERVLET_HEADER", "getHeaders": "SERVLET_HEADERS", "getCookies": "SERVLET_COOKIES", "getInputStream": "SERVLET_INPUT_STREAM",
    "getReader": "SERVLET_READER", "getQueryString": "SERVLET_QUERY_STRING", "getPathInfo": "SERVLET_PATH_INFO"}

# Security effects as (effect, rule, types, methods, mechanism pattern, critical argument; -1 is the receiver).
EFFECTS = (
    ("FILESYSTEM_ACCESS", "JDK_NIO_FILES_PATH_ARG0", ("java.nio.file.Files",),
     ("newInputStream", "newOutputStream", "newBufferedReader", "newBufferedWriter", "readAllBytes", "readAllLines", "readString", "write", "writeString", "copy",
      "move", "delete", "deleteIfExists", "createFile", "createDirectory", "createDirectories", "createTempFile", "createTempDirectory"), "JAVA_NIO_FILES_{method}", 0),
    ("FILESYSTEM_ACCESS", "JDK_CLASS_RESOURCE_NAME_ARG0", ("java.lang.Class",), ("getResource", "getResourceAsStream"), "JAVA_CLASS_{method}", 0),
    ("FILESYSTEM_ACCESS", "JDK_CLASSLOADER_RESOURCE_NAME_ARG0", ("java.lang.ClassLoader",), ("getResource", "getResourceAsStream", "getResources"), "JAVA_CLASSLOADER_{method}", 0),
    ("FILESYSTEM_ACCESS", "JDK_FILE_PATH_RECEIVER", ("java.io.File",),
     ("canRead", "canWrite", "exists", "isDirectory", "isFile", "list", "listFiles", "delete", "mkdir", "mkdirs", "createNewFile"), "JAVA_IO_FILE_{method}", -1),
    ("PROCESS_EXECUTION", "JDK_RUNTIME_EXEC_ARG0", ("java.lang.Runtime",), ("exec",), "RUNTIME_EXEC", 0),
    ("PROCESS_EXECUTION", "JDK_PROCESS_BUILDER_START_RECEIVER", ("java.lang.ProcessBuilder",), ("start",), "PROCESS_BUILDER_START", -1),
    ("RENDERING", "SERVLET_RESPONSE_REDIRECT_ARG0", ("javax.servlet.http.HttpServletResponse", "jakarta.servlet.http.HttpServletResponse"), ("sendRedirect",), "SERVLET_RESPONSE_SEND_REDIRECT", 0),
    ("RENDERING", "SERVLET_RESPONSE_HEADER_VALUE_ARG1", ("javax.servlet.http.HttpServletResponse", "jakarta.servlet.http.HttpServletResponse"), ("setHeader", "addHeader"), "SERVLET_RESPONSE_{method}", 1),
    ("DYNAMIC_EVALUATION", "JDK_SCRIPT_ENGINE_EVAL_ARG0", ("javax.script.ScriptEngine", "javax.script.AbstractScriptEngine"), ("eval",), "SCRIPT_ENGINE_EVAL", 0),
    ("DYNAMIC_EVALUATION", "SPRING_EXPRESSION_PARSE_ARG0", ("org.springframework.expression.ExpressionParser",), ("parseExpression",), "SPRING_EXPRESSION_PARSE", 0),
    ("REGEX_EVALUATION", "JDK_PATTERN_COMPILE_REGEX_ARG0", ("java.util.regex.Pattern",), ("compile",), "JAVA_PATTERN_COMPILE", 0),
    ("REGEX_EVALUATION", "JDK_PATTERN_MATCHER_INPUT_ARG0", ("java.util.regex.Pattern",), ("matcher",), "JAVA_PATTERN_MATCHER", 0),
    ("REGEX_EVALUATION", "JDK_STRING_REGEX_ARG0", ("java.lang.String",), ("matches", "replaceAll", "replaceFirst", "split"), "JAVA_STRING_{method}", 0),
    ("DESERIALIZATION", "JDK_OBJECT_INPUT_STREAM_RECEIVER", ("java.io.ObjectInputStream",), ("readObject", "readUnshared"), "JAVA_OBJECT_INPUT_STREAM_{method}", -1),
    ("DESERIALIZATION", "JDK_XML_DECODER_RECEIVER", ("java.beans.XMLDecoder",), ("readObject",), "JAVA_XML_DECODER_READ_OBJECT", -1),
    ("NETWORK_OUTPUT", "JDK_URL_REQUEST_RECEIVER", ("java.net.URL",), ("openConnection", "openStream"), "JAVA_URL_{method}", -1),
    ("NETWORK_OUTPUT", "JDK_URL_CONNECTION_RECEIVER", ("java.net.URLConnection",), ("connect",), "JAVA_URL_CONNECTION_CONNECT", -1),
    ("NETWORK_OUTPUT", "JDK_HTTP_CLIENT_REQUEST_ARG0", ("java.net.http.HttpClient",), ("send", "sendAsync"), "JAVA_HTTP_CLIENT_{method}", 0),
    ("NETWORK_OUTPUT", "SPRING_REST_OPERATIONS_URL_ARG0", ("org.springframework.web.client.RestOperations", "org.springframework.web.client.RestTemplate"),
     ("getForObject", "getForEntity", "postForObject", "postForEntity", "put", "delete", "exchange", "headForHeaders", "optionsForAllow"), "SPRING_REST_{method}", 0),
    ("CRYPTOGRAPHIC_CONFIGURATION", "JCA_ALGORITHM_NAME_ARG0", (
        "javax.crypto.Cipher", "javax.crypto.KeyGenerator", "java.security.MessageDigest", "java.security.Signature", "java.security.KeyPairGenerator",
        "java.security.KeyFactory", "java.security.AlgorithmParameters"), ("getInstance",), "JCA_{type}_GET_INSTANCE", 0),
)
# Response body writes, recognised by the accessor the call is made on.
BODY_ACCESSORS = ("getWriter", "getOutputStream")
BODY_WRITES = ("write", "print", "println", "printf", "append")
RESPONSE_TYPES = ("ServletResponse", "HttpServletResponse")

# Handler annotations, by package and name, of request and of message boundaries.
REQUEST_HANDLERS = {
    (SPRING_WEB,): ("RequestMapping", "GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping"),
    ("javax.ws.rs", "jakarta.ws.rs"): ("Path", "GET", "POST", "PUT", "DELETE", "PATCH")}
MESSAGE_PACKAGES = (
    "org.springframework.context.event", "org.springframework.kafka.annotation", "org.springframework.amqp.rabbit.annotation",
    "org.springframework.jms.annotation", "org.springframework.messaging.handler.annotation", "javax.websocket", "jakarta.websocket")
MESSAGE_HANDLERS = ("EventListener", "KafkaListener", "RabbitListener", "JmsListener", "MessageMapping", "OnMessage")
# Endings of boundary parameter types, and names of callbacks.
REQUEST_SUFFIXES = ("Request", "Context", "Event", "Message", "Payload")
CALLBACK_NAMES = ("onMessage", "onEvent", "handle", "handleRequest", "accept", "apply", "invoke")

# Sensitive receivers as (type suffixes, methods, reason, category, evidence, confidence).
RECEIVERS = (
    (("Repository", "Store", "Storage", "FileSystem"), ("save", "store", "write", "put", "delete", "remove", "load", "read"), "STORAGE_ABSTRACTION", "STORAGE", "SENSITIVE_RECEIVER_AND_METHOD", "STRUCTURE_HIGH"),
    (("CommandExecutor", "ProcessExecutor", "Shell"), ("execute", "exec", "run", "start"), "PROCESS_ABSTRACTION", "PROCESS_EXECUTION", "PROCESS_RECEIVER_AND_METHOD", "STRUCTURE_HIGH"),
    (("Template", "Renderer", "ResponseWriter"), ("render", "process", "evaluate", "write", "print", "send"), "FRAMEWORK_OUTPUT", "OUTPUT", "OUTPUT_RECEIVER_AND_METHOD", "STRUCTURE_MEDIUM"),
    (("Client", "Gateway", "Publisher"), ("send", "publish", "post", "put", "exchange", "execute"), "THIRD_PARTY_EFFECT", "NETWORK_OR_MESSAGE_OUTPUT", "CLIENT_RECEIVER_AND_METHOD", "STRUCTURE_MEDIUM"),
    (("Deserializer",), ("deserialize", "read", "parse"), "DYNAMIC_OPERATION", "DESERIALIZATION", "DESERIALIZER_RECEIVER_AND_METHOD", "STRUCTURE_HIGH"),
)

# The categories.
CATEGORIES = ("CWE-22", "CWE-78", "CWE-79", "CWE-94")
# Name patterns of inputs and, per category, of effects.
SOURCE_TERMS = (
    r"(?i)^(?:get(?:query|parameter|header|cookie|request|input|body|pathinfo|env)|"
    r"read(?:line|object|utf|input)|receive|accept|nextline|main|do(?:get|post|put|delete)|handle|onmessage)")
SINK_TERMS = {
    "CWE-22": r"(?i)^(?:open|newinputstream|newoutputstream|readall|readstring|file(?:input|output)?stream|randomaccessfile|file|resolve|createfile|copy|move|delete|extract)",
    "CWE-78": r"(?i)^(?:exec(?:ute)?|processbuilder|start|spawn|command|launch)",
    "CWE-79": r"(?i)^(?:write|print|println|append|send|render|respond|redirect|output)",
    "CWE-94": r"(?i)^(?:eval(?:uate)?|execute|compile|defineclass|loadclass|forname|invoke|parseexpression|interpret|render)",
}
# Text terms that mark a boundary, per category.
BOUNDARY_TERMS = {
    "CWE-22": r"path|file|director|resource|archive|zip|extract|canonical|normaliz|contain|allow",
    "CWE-78": r"command|process|shell|exec|launcher|script|checkout|workspace|scm",
    "CWE-79": r"html|response|render|writer|print|escape|encod|saniti|template",
    "CWE-94": r"script|eval|expression|template|compile|classload|reflect|groovy|interpret",
}


def effect_rows() -> list[tuple]:
    """(type, method, effect, rule, mechanism, index) of every plain effect rule."""
    return [
        (t, m, effect, rule, pattern.format(method=m, type=t.rsplit(".", 1)[1]), index)
        for effect, rule, types, methods, pattern, index in EFFECTS for t in types for m in methods
    ]


def annotation_rows() -> list[tuple]:
    return [(p, name, mechanism) for packages, names in INPUT_ANNOTATIONS.items() for p in packages for name, mechanism in names.items()]


def accessor_rows() -> list[tuple]:
    return [(t, name, word) for t in SERVLET_REQUESTS for name, word in SERVLET_ACCESSORS.items()]


def handler_rows() -> list[tuple]:
    requests = [(p, n, "ANNOTATED_BOUNDARY", "FRAMEWORK_HANDLER_ANNOTATION") for ps, ns in REQUEST_HANDLERS.items() for p in ps for n in ns]
    return requests + [(p, n, "MESSAGE_EVENT_BOUNDARY", "MESSAGE_OR_EVENT_HANDLER_ANNOTATION") for p in MESSAGE_PACKAGES for n in MESSAGE_HANDLERS]


def table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
