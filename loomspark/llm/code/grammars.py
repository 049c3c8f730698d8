"""Grammars of the languages, and how bracket contents are cut into pieces that are parsed alone."""

from __future__ import annotations

from functools import cache

from loomspark.llm.code.chart import Grammar

# Reserved words of each language.
RESERVED = {
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "js": "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while",
    "cpp": "alignas alignof asm auto bool break case catch char class const constexpr consteval constinit const_cast continue co_await co_return co_yield decltype default delete do double dynamic_cast else enum explicit export extern false float for friend goto if inline int long mutable namespace new noexcept nullptr operator private protected public register reinterpret_cast return short signed sizeof static static_assert static_cast struct switch template this thread_local throw true try typedef typeid typename union unsigned using virtual void volatile wchar_t while concept requires char8_t char16_t char32_t",
    "ruby": "alias and begin break case class def defined? do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield",
    "json": "true false null",
}
#: Words with a meaning only in some places; they are names elsewhere.
SOFT = {
    "python": "match case type _",
    "js": "async await yield let static get set of from as type interface namespace declare abstract readonly public private protected implements keyof is infer satisfies override accessor module property signal required alias component pragma asserts unique",
    "java": "record sealed permits var yield non when module open with",
    "go": "",
    "rust": "union auto default macro_rules",
    "cpp": "override final import module",
    "ruby": "",
    "json": "NaN",
}
_BINARY = "+ - * / % == != < > <= >= && || & | ^ <<"
_ASSIGN = "= += -= *= /= %= &= |= ^= <<= >>= "

_JS = """
stm = stmt*
stmt = ';' | B:stm | export? decl | expr ';' | 'return' expr? ';' | 'throw' expr ';' | ('break' | 'continue') ID? ';' | 'debugger' ';' | 'if' P:expr stmt ('else' stmt)? | 'while' P:expr stmt
   | 'do' stmt 'while' P:expr ';'? | 'for' 'await'? P:for_head stmt | 'switch' P:expr B:cases | 'try' B:stm ('catch' (P:binding)? B:stm)? ('finally' B:stm)? | ID ':' stmt | 'with' P:expr stmt | import | exports
export = 'export' 'default'? | 'declare' | 'export' 'declare' | decorator+ | decorator+ 'export' 'default'?
decorator = '@' ID ('.' name)* (P:args)?
decl = function | 'async' function | class | vars ';'
function = 'function' '*'? ID? fparams
class = 'abstract'? 'class' ID? ('extends' post)? B:class
vars = ('var' | 'let' | 'const') var (',' var)*
var = target ('=' assign)?
target = ID | S:binding_list | B:binding_list
binding_list = (target_key)? ('=' assign)? | '...' target
target_key = target | (name | S:expr) ':' target
binding = target
fparams = P:params B:stm
param = decorator* ('...')? target ('=' assign)?
import = 'import' STR with? ';' | 'import' import_names 'from' STR with? ';' | 'import' P:args suffix* ';' 
with = 'with' B:obj
import_names = ID | B:names | '*' 'as' ID | ID ',' B:names | ID ',' '*' 'as' ID
exports = 'export' (B:names | '*' | '*' 'as' name) ('from' STR with?)? ';' | 'export' 'default' expr ';'
named = (name | STR) ('as' (name | STR))?
for_head = (('var' | 'let' | 'const') target | post) ('of' | 'in') expr | (vars | expr)? ';' expr? ';' expr?
cases = (('case' expr | 'default') ':' stm)*
member = ';' | decorator* modifier* member_name fparams | decorator* modifier* member_name ('=' assign)? ';' | 'static' B:stm
modifier = 'static' | 'async' | 'get' | 'set' | '*' | 'accessor'
member_name = name | STR | NUM | S:assign
class_body = member*
expr = assign (',' assign)*
assign = cond | arrow | 'yield' '*'? assign | 'yield'
arrow = 'async'? (ID | P:params) '=>' (B:stm | assign)
cond = unary (binop unary)* ('?' assign ':' assign)? | unary (binop unary)* ASSIGN assign | unary (binop unary)* binop arrow
binop = BIN | '>' '>' | '>' '>' '>' | '>' '>='
unary = PRE unary | post
post = prim suffix* ('++' | '--')?
suffix = '.' name | '?.' name | '?.' P:args | '?.' S:expr | P:args | S:expr | STR
prim = ID | NUM | STR | JSX | KEYVALUE | P:expr | S:list | B:obj | function | 'async' function | class | 'new' post | 'new' '.' ID | 'import' P:args | 'import' '.' ID
arg = ('...')? assign
elem = (('...')? assign)?
prop = '...' assign | modifier* member_name fparams | member_name ':' assign | ID ('=' assign)?
name = ID | KEYWORD
"""
_TS = (
    _JS.replace("vars = ('var' | 'let' | 'const') var", "vars = ('var' | 'let' | 'const' | 'const' 'enum') var")
    .replace("var = target ('=' assign)?", "var = target '!'? annotation? ('=' assign)?")
    .replace("function = 'function' '*'? ID? fparams", "function = 'function' '*'? ID? fparams | 'function' '*'? ID? generics? P:params returns? ';'")
    .replace("class = 'abstract'? 'class' ID? ('extends' post)? B:class", "class = 'abstract'? 'class' ID? generics? ('extends' post targs?)? ('implements' type (',' type)*)? B:class")
    .replace("decl = function", "decl = 'type' ID generics? '=' type ';' | 'interface' ID generics? ('extends' type (',' type)*)? B:type_body | 'const'? 'enum' ID B:enum | ('namespace' | 'module') (STR | ID ('.' ID)*) B:stm | 'abstract' class | function")
    .replace("fparams = P:params B:stm", "fparams = generics? P:params returns? B:stm")
    .replace("param = decorator* ('...')? target ('=' assign)?", "param = decorator* access* ('...')? (target | 'this') '?'? annotation? ('=' assign)?\naccess = 'public' | 'private' | 'protected' | 'readonly' | 'override'")
    .replace("binding = target", "binding = target annotation?")
    .replace("member_name ('=' assign)? ';'", "member_name ('?' | '!')? annotation? ('=' assign)? ';' | decorator* modifier* member_name '?'? generics? P:params returns? ';' | modifier* S:type_index annotation ';'")
    .replace("modifier = 'static'", "modifier = access | 'abstract' | 'declare' | 'static'")
    .replace("arrow = 'async'? (ID | P:params) '=>'", "arrow = 'async'? (ID | generics? P:params returns?) '=>'")
    .replace("import = 'import' STR", "import = 'import' 'type' import_names 'from' STR ';' | 'import' ID '=' expr ';' | 'import' STR")
    .replace("exports = 'export'", "exports = 'export' 'type' B:names ('from' STR)? ';' | 'export' '=' expr ';' | 'export'")
    .replace("named = ", "named = 'type'? ")
    .replace("binop = BIN", "binop = BIN")
    .replace("post = prim suffix* ('++' | '--')?", "post = prim suffix* ('++' | '--')? | post ('as' | 'satisfies') type | '<' type '>' unary")
    .replace("suffix = '.' name", "suffix = '!' | targs P:args | '.' name")
    + """annotation = ':' type
returns = ':' type | ':' 'asserts'? (ID | 'this') 'is' type | ':' 'asserts' ID
generics = '<' generic (',' generic)* ','? '>'
generic = 'const'? ('in' | 'out')? ID ('extends' type)? ('=' type)?
targs = '<' type (',' type)* '>'
type = union ('extends' union '?' type ':' type)? | generics? P:type_params '=>' type | 'new' generics? P:type_params '=>' type | 'asserts'? ID 'is' type
union = ('|' | '&')? array (('|' | '&') array)*
array = simple (S:type_opt)*
type_opt = type?
simple = ID ('.' ID)* targs? | NUM | '-' NUM | STR | 'null' | 'true' | 'false' | 'void' | 'this' | P:type | B:type_body | S:tuple | 'typeof' ID ('.' name)* | 'keyof' array | 'readonly' array | 'infer' ID | 'unique' ID | 'import' P:args ('.' ID)* targs?
tuple = ('...')? (ID '?'? ':')? type '?'?
type_params = decorator* ('...')? (target | 'this') '?'? annotation?
type_body = (type_member (';' | ',')?)*
type_member = access* member_name '?'? annotation? | access* member_name '?'? generics? P:type_params returns? | generics? P:type_params returns? | 'new' generics? P:type_params returns? | access* ('-' | '+')? S:type_index '?'? annotation? | ('get' | 'set') member_name P:type_params returns?
type_index = ID ':' type | ID 'in' type ('as' type)? | assign
enum = (name | STR) ('=' assign)?
"""
)
_QML = (
    _JS.replace("stm = stmt*", "file = head* object\nhead = 'pragma' ID (':' ID)? ';' | 'import' (STR | ID ('.' ID)*) NUM? ('as' ID)? ';'\nobject = ID ('.' ID)* B:qml\nqml = item*\nstm = stmt*")
    + """item = ';' | object ';'? | ID ('.' ID)* object | ID ('.' ID)* ':' value | qmod* 'property' qtype ID (':' value)? ';'? | qmod* 'property' 'alias' ID ':' value | 'signal' ID (P:qparams)? ';'? | function ';'? | 'component' ID ':' object | 'enum' ID B:enum | ID ('.' ID)* 'on' ID B:qml
qmod = 'default' | 'readonly' | 'required'
qtype = (ID | 'var' | 'enum') ('.' ID)* ('<' qtype '>')?
qparams = qtype ID | ID ':' qtype
value = object ';'? | S:qlist ';'? | stmt
qlist = object | assign
enum = ID ('=' NUM)?
"""
)
_JAVA = """
file = ';' | annotation* 'package' dotted ';' | 'import' 'static'? dotted ('.' '*')? ';' | typedecl | stmt_member
stmt_member = mods (type ID dims vrest ';' | generics? type ID P:params dims throws? (B:stm | ';'))
unit = file*
dotted = ID ('.' ID)*
annotation = '@' dotted (P:anno)?
anno = ID '=' avalue | avalue
avalue = cond | annotation | B:alist
alist = avalue
mods = (annotation | MOD | 'sealed' | 'non' '-' 'sealed' | 'default')*
typedecl = mods 'class' ID generics? ('extends' type)? ('implements' types)? ('permits' types)? B:class | mods 'interface' ID generics? ('extends' types)? ('permits' types)? B:class | mods 'enum' ID ('implements' types)? B:enum_body | mods 'record' ID generics? P:params ('implements' types)? B:class | mods '@' 'interface' ID B:class
types = type (',' type)*
class_body = member*
member = ';' | typedecl | 'static'? B:stm | mods type var (',' var)* ';' | mods generics? type ID P:params dims throws? (B:stm | ';') | mods generics? ID P:params throws? B:stm | mods ID B:stm | mods type ID P:params 'default' avalue ';'
throws = 'throws' types
enum_body = (annotation* ID (P:args)? (B:class)? (',' annotation* ID (P:args)? (B:class)?)*)? ','? (';' member*)?
generics = '<' generic (',' generic)* '>'
generic = annotation* ID ('extends' type ('&' type)*)?
type = annotation* (PRIM | ID targs? ('.' annotation* ID targs?)*) dims
targs = '<' (targ (',' targ)*)? '>'
targ = type | annotation* '?' (('extends' | 'super') type)?
dims = (S:nothing)*
nothing = 
vrest = ('=' init)? (',' var)*
var = ID dims ('=' init)?
init = assign | B:init_list
init_list = init
param = mods type ('...')? ID dims | mods type ID '.' 'this' | mods type 'this' | type ID
stm = stmt*
stmt = ';' | B:stm | typedecl | mods type var (',' var)* ';' | expr ';' | 'return' assign? ';' | 'throw' assign ';' | ('break' | 'continue') ID? ';' | 'yield' assign ';' | 'assert' assign (':' assign)? ';' | 'if' P:expr stmt ('else' stmt)? | 'while' P:expr stmt | 'do' stmt 'while' P:expr ';' | 'for' P:for_head stmt
   | 'switch' P:expr B:cases | 'try' (P:resources)? B:stm ('catch' P:catch B:stm)* ('finally' B:stm)? | 'synchronized' P:expr B:stm | ID ':' stmt
resources = resource (';' resource)* ';'?
resource = mods type ID '=' assign | post
catch = mods type ('|' type)* ID
for_head = mods type ID ':' assign | (mods type var (',' var)* | expr)? ';' assign? ';' expr?
cases = (('case' label (',' label)* ('when' assign)? | 'default' | 'case' 'null' ',' 'default') (':' stm | '->' (assign ';' | B:stm | 'throw' assign ';')))*
label = cond | type ID | ID P:patterns
patterns = type ID | ID P:patterns
expr = assign (',' assign)*
assign = cond | cond ASSIGN assign | lambda | cond '>' '>=' assign | cond '>' '>' '>=' assign
lambda = (ID | P:lambda_params) '->' (assign | B:stm)
lambda_params = param | ID
cond = binary ('?' assign ':' (cond | lambda))?
binary = unary (binop unary | 'instanceof' 'final'? type (ID | P:patterns)?)*
binop = BIN | '>' '>' | '>' '>' '>'
unary = PRE unary | P:type unary | P:type lambda | post
post = prim suffix* ('++' | '--')?
suffix = '.' targs? ID | '.' 'this' | '.' 'class' | '.' 'super' | '.' 'new' ID targs? P:args (B:class)? | P:args | S:assign | '::' (ID | 'new')
prim = ID | NUM | STR | 'true' | 'false' | 'null' | 'this' | 'super' | P:assign | 'new' annotation* newtype (P:args (B:class)? | (S:assign)+ dims | dims B:init_list) | PRIM dims '.' 'class' | ID dims '.' 'class' | type '::' (ID | 'new') | 'switch' P:expr B:cases | 'void' '.' 'class'
newtype = PRIM | ID targs? ('.' ID targs?)*
arg = assign
"""
_GO = """
unit = (top ';'?)*
top = 'package' ID ';' | 'import' (spec_import | P:imports) ';' | decl ';' | ';'
imports = (spec_import ';')* spec_import?
spec_import = (ID | '.')? STR
decl = ('var' | 'const') (spec | P:specs) | 'type' (tspec | P:tspecs) | 'func' receiver? ID tparams? signature (B:stm)?
receiver = P:params
specs = (spec ';')* spec?
spec = ID (',' ID)* type? ('=' exprs)?
tspecs = (tspec ';')* tspec?
tspec = ID tparams? '='? type
tparams = S:tparam
tparam = ID? union
union = '~'? type ('|' '~'? type)*
signature = P:params (P:params | type)?
param = ID? ('...')? type | ID
type = ID ('.' ID)? (S:type_args)? | '*' type | S:array_len type | 'map' S:type type | 'chan' '<-'? type | '<-' 'chan' type | 'func' signature | 'struct' B:fields | 'interface' B:methods | P:type
array_len = ('...' | expr)?
type_args = type
fields = (field ';')* field?
field = (ID (',' ID)* type | '*'? ID ('.' ID)?) STR?
methods = (method ';')* method?
method = ID signature | union
stm = (stmt ';')* stmt?
stmt =  | 'fallthrough' | decl | simple | 'return' exprs? | ('break' | 'continue' | 'goto') ID? | ('go' | 'defer') expr | B:stm | ifs | 'for' (simple? ';' expr? ';' simple? | expr | (exprs ('=' | ':='))? 'range' expr)? B:stm | 'switch' (simple ';')? simple? B:cases | 'switch' (simple ';')? (ID ':=')? expr '.' P:type_word B:cases | 'select' B:cases | ID ':' stmt
type_word = 'type'
ifs = 'if' (simple? ';')? expr B:stm ('else' (ifs | B:stm))?
cases = (('case' (exprs | types | simple) | 'default') ':' stm)*
types = type (',' type)*
simple = expr | expr ('++' | '--') | exprs (':=' | ASSIGN) exprs | expr '<-' expr
exprs = expr (',' expr)*
expr = unary (binop unary)*
binop = BIN | '>' '>'
unary = PRE unary | post
post = prim suffix*
suffix = '.' ID | '.' P:assertion | P:args | S:index | B:lit
assertion = type | 'type'
index = expr | expr? ':' expr? (':' expr)? | type
prim = ID | NUM | STR | P:expr | 'func' signature B:stm | S:array_len type B:lit | 'map' S:type type B:lit | 'struct' B:fields B:lit | S:array_len type | 'map' S:type type | 'chan' type | P:ptr | 'interface' B:methods | 'struct' B:fields
ptr = '*' type
lit = (elem | elem ':' elem)
elem = expr | B:lit
arg = expr '...'? | type
"""
_RUST = """
unit = item*
item = ';' | attr* vis? (fn | struct | enum | impl | trait | mod | use | const | alias | extern | union) | attr* macro_item
attr = '#' '!'? S:any
vis = 'pub' (P:any)?
macro_item = path '!' ID? (P:any ';' | S:any ';' | B:any)
fn = fnmods 'fn' ID generics? P:params ('->' type)? where? (B:stm | ';')
fnmods = ('const' | 'async' | 'unsafe' | 'extern' STR? | 'default')*
struct = 'struct' ID generics? where? (B:fields | ';') | 'struct' ID generics? P:tuple_fields where? ';'
union = 'union' ID generics? where? B:fields
enum = 'enum' ID generics? where? B:variants
variant = attr* vis? ID (P:tuple_fields | B:fields)? ('=' expr)?
field = attr* vis? ID ':' type
tuple_field = attr* vis? type
impl = 'unsafe'? 'impl' generics? 'const'? '!'? type ('for' type)? where? B:items
trait = 'unsafe'? 'auto'? 'trait' ID generics? (':' bounds?)? where? B:items
items = attr* item*
mod = 'unsafe'? 'mod' ID (';' | B:unit)
use = 'use' tree ';'
tree = '::'? (seg '::')* (seg ('as' ID)? | '*' | B:trees)
trees = tree
seg = ID | 'crate' | 'self' | 'super' | 'Self'
const = ('const' | 'static' 'mut'?) ID ':' type ('=' expr)? ';'
alias = 'type' ID generics? (':' bounds)? where? ('=' type)? ';'
extern = 'unsafe'? 'extern' STR? B:items | 'extern' 'crate' seg ('as' ID)? ';'
generics = '<' (generic (',' generic)* ','?)? '>'
generic = attr* (LIFE (':' LIFE ('+' LIFE)*)? | ID (':' bounds?)? ('=' type)? | 'const' ID ':' type ('=' (prim | B:stm))?)
where = 'where' (clause (',' clause)* ','?)?
clause = hr? type ':' bounds? | LIFE ':' LIFE ('+' LIFE)*
hr = 'for' '<' LIFE (',' LIFE)* '>'
bounds = bound ('+' bound)*
bound = LIFE | '?'? hr? tpath | P:bound
type = '&' LIFE? 'mut'? type | '&&' LIFE? 'mut'? type | '*' ('const' | 'mut') type | P:types | S:array_type | '!' | 'dyn' bounds | 'impl' bounds | tpath | hr? fnmods 'fn' P:fn_types ('->' type)? | '<' type ('as' tpath)? '>' '::' tpath | path '!' P:any | '_'
types = type
fn_types = (ID ':')? type
array_type = type (';' expr)?
tpath = '::'? tseg ('::' tseg)*
tseg = seg targs? | seg '::' targs | seg P:types ('->' type)?
targs = '<' (targ (',' targ)* ','?)? '>'
targ = LIFE | type | ID '=' type | ID ':' bounds | NUM | STR | B:stm | '-' NUM | 'true' | 'false'
param = attr* ('&' LIFE? 'mut'? 'self' | 'mut'? 'self' (':' type)? | pattern ':' type | type | '...')
pattern = '|'? pat ('|' pat)*
pat = '&' 'mut'? pat | '&&' 'mut'? pat | 'ref'? 'mut'? ID ('@' pat)? | '_' | '..' | lit (('..=' | '..' | '...') lit?)? | '..=' lit | ppath (('..=' | '..') ppath?)? | ppath P:patterns | ppath B:field_pats | P:patterns | S:patterns | path '!' P:any | 'box' pat
ppath = '::'? tseg ('::' tseg)*
patterns = attr* pattern
field_pats = attr* ('ref'? 'mut'? ID | (ID | NUM) ':' pattern | '..')
lit = '-'? NUM | STR | 'true' | 'false'
stm = inner* stmt* (attr* expr)?
inner = '#' '!' S:any
stmt = item | attr* 'let' pattern (':' type)? ('=' expr ('else' B:stm)?)? ';' | attr* block_expr | attr* expr ';'
block_expr = (LIFE ':')? ('unsafe' | 'async' 'move'? | 'const')? B:stm | 'if' cond_expr B:stm ('else' 'if' cond_expr B:stm)* ('else' B:stm)? | 'match' expr B:arms | (LIFE ':')? 'loop' B:stm | (LIFE ':')? 'while' cond_expr B:stm | (LIFE ':')? 'for' pattern 'in' expr B:stm | path '!' B:any
cond_expr = expr | 'let' pattern '=' expr | cond_expr '&&' 'let' pattern '=' expr
arms = inner* (attr* pattern ('if' cond_expr)? '=>' (expr ',' | block_expr ','? | expr))*
expr = range (ASSIGN expr)? | range '>' '>=' expr | 'return' expr? | 'break' LIFE? expr? | 'continue' LIFE? | closure
closure = 'static'? 'async'? 'move'? ('||' | '|' (cparam (',' cparam)* ','?)? '|') ('->' type B:stm | expr)
cparam = attr* pat (':' type)?
range = binary (('..' | '..=') binary?)? | ('..' | '..=') binary?
binary = unary (binop unary | 'as' type)* | unary (binop unary)* binop closure
binop = BIN | '>' '>'
unary = PRE unary | '&' 'raw'? ('mut' | 'const')? unary | '&&' 'mut'? unary | post
post = prim suffix*
suffix = '.' (ID | NUM | 'await') | '.' ID '::' targs | P:args | S:expr | '?'
prim = NUM | STR | 'true' | 'false' | epath | epath B:struct_lit | path '!' (P:any | S:any | B:any) | P:args | S:array_lit | block_expr
epath = '::'? eseg ('::' eseg)* | '<' type ('as' tpath)? '>' '::' eseg ('::' eseg)*
eseg = seg | '<' (targ (',' targ)* ','?)? '>'
path = '::'? seg ('::' seg)*
array_lit = expr (';' expr)?
struct_lit = attr* (ID | NUM) (':' expr)? | '..' expr?
arg = attr* expr
"""
_CPP = """
unit = decl*
decl = ';' | PP | 'namespace' attr* (ID ('::' ID)*)? B:unit | 'namespace' ID '=' qname ';' | 'inline' 'namespace' ID B:unit | 'extern' STR (B:unit | decl) | template decl | 'using' 'namespace' qname ';' | 'using' 'typename'? qname ';' | 'using' ID attr* '=' type adecl? ';' | 'static_assert' P:args ';' | 'typedef' spec+ declarators ';' | 'typedef' classy declarators ';' | classy declarators? ';' | func | var ';' | attr+ decl | ID P:any | ID P:any ';' | 'export' decl | ('import' | 'module') (qname | '<' qname '>' | STR)? ';' | 'template' decl | concept | 'friend' decl
concept = 'concept' ID '=' expr ';'
template = 'template' '<' (tparam (',' tparam)*)? '>' requires?
requires = 'requires' expr
tparam = ('typename' | 'class') '...'? ID? ('=' type adecl?)? | type adecl? ('...')? ID? ('=' shift)? | template ('typename' | 'class') ID? ('=' qname)?
attr = S:any | 'alignas' P:any
classy = spec* ('class' | 'struct' | 'union') attr* qname? 'final'? (':' bases)? B:class | spec* 'enum' ('class' | 'struct')? attr* qname? (':' type)? B:enum | spec* ('class' | 'struct' | 'enum' 'class'?) qname (':' type)?
bases = base (',' base)*
base = ('virtual' | 'public' | 'private' | 'protected')* qname '...'?
class_body = member*
member = ('public' | 'private' | 'protected' | ID) ':' | decl | var (':' expr)? ';' | spec+ ':' expr ';'
enum = ID attr* ('=' cond)?
spec = 'static' | 'const' | 'constexpr' | 'consteval' | 'constinit' | 'inline' | 'virtual' | 'explicit' | 'explicit' P:args | 'extern' | 'mutable' | 'volatile' | 'register' | 'thread_local' | 'friend' | attr | base_type
base_type = PRIM | 'auto' | 'decltype' P:args | 'typename'? qname | ('struct' | 'class' | 'enum' | 'union') qname
type = spec+
qname = '::'? qseg ('::' 'template'? qseg)* 
qseg = ID targs? | '~' ID
targs = '<' (targ (',' targ)*)? '>'
targ = type adecl? '...'? | shift | type adecl '...'
adecl = ptr+ adirect? | adirect
adirect = P:params fquals? | (S:opt)+ | P:adecl_in (P:params | S:opt)*
adecl_in = ptr+ ID?
opt = expr?
ptr = '*' ('const' | 'volatile')* | '&' | '&&' | qname '::' '*'
declarators = declarator init? (',' declarator init?)*
declarator = ptr* direct
direct = qname attr* | P:declarator_in | direct P:params fquals? | direct S:opt
declarator_in = ptr* direct
init = '=' (assign | B:init_list) | B:init_list | P:args
var = spec+ declarators | spec+ S:names init
fquals = ('const' | 'noexcept' | 'noexcept' P:args | 'override' | 'final' | '&' | '&&' | 'volatile' | 'throw' P:any | attr | '->' type adecl? | requires)+
func = spec* ptr* fname P:params fquals? (B:stm | ';' | '=' ('default' | 'delete' | NUM) ';' | ':' inits B:stm | 'try' B:stm handler+)
fname = qname | (qname '::')? operator
operator = 'operator' (OPERATOR | P:nothing | S:nothing | type ptr* | 'new' | 'delete' | '>' '>' | '>' '>=' | STR ID)
nothing = 
inits = minit (',' minit)*
minit = qname (P:args | B:init_list) '...'?
param = attr* spec+ declarator ('=' (assign | B:init_list))? | attr* spec+ adecl? ('=' (assign | B:init_list))? | '...' | spec+ ptr* '...' ID? 
names = ID
init_list = '.' ID ('=' assign | B:init_list) | S:expr '=' init_elem | init_elem
init_elem = assign '...'? | B:init_list
stm = stmt*
stmt = ';' | PP | B:stm | decl | expr ';' | 'return' (expr | B:init_list)? ';' | 'co_return' expr? ';' | 'throw' expr? ';' | ('break' | 'continue') ';' | 'goto' ID ';' | ID ':' | 'case' cond ('...' cond)? ':' | 'default' ':' | 'if' 'constexpr'? P:cond_head stmt ('else' stmt)? | 'while' P:cond_head stmt | 'do' stmt 'while' P:expr ';' | 'for' P:for_head stmt | 'switch' P:cond_head stmt | 'try' B:stm handler+ | attr stmt
handler = 'catch' P:catch B:stm
catch = '...' | spec+ ptr* ID?
cond_head = (var ';' | expr ';')? (expr | var)
for_head = (var | expr)? ';' expr? ';' expr? | (var ';')? spec+ ptr* (ID | S:names) ':' (expr | B:init_list)
expr = assign (',' assign)*
assign = cond | cond ASSIGN (assign | B:init_list) | 'throw' assign? | cond '>' '>=' assign
cond = shift ('?' expr ':' assign)?
shift = unary (binop unary)*
binop = BIN | '>' '>'
unary = PRE unary | 'sizeof' '...'? P:args | P:cast unary | ('new' | '::' 'new') (P:args)? spec+ ptr* (S:expr)* (P:args | B:init_list)? | '::'? 'delete' (S:nothing)? unary | post
cast = type adecl?
post = prim suffix*
suffix = '.' 'template'? member_name | '->' 'template'? member_name | P:args | S:expr | '++' | '--' | B:init_list | '...' | '.*' | '->*' prim
member_name = qname | operator
prim = qname | NUM | STR+ | 'true' | 'false' | 'nullptr' | 'this' | P:expr | P:fold | lambda | CASTS '<' type adecl? '>' P:expr | 'typeid' P:args | PRIM (P:args | B:init_list) | 'decltype' P:args | 'alignof' P:args | 'noexcept' P:args | 'auto' (P:args | B:init_list) | 'operator' OPERATOR | 'requires' (P:params)? B:any | 'typename' qname (P:args | B:init_list)
fold = ('...' foldop)? unary (foldop '...' (foldop unary)?)?
foldop = BIN | ','
lambda = S:captures ('<' (tparam (',' tparam)*)? '>')? (P:params)? ('mutable' | 'constexpr' | 'noexcept')* ('->' type adecl?)? B:stm
captures = '&' | '=' | '&'? ID '...'? ('=' assign)? | 'this' | '*' 'this' | '&' ID
arg = init_elem | type adecl?
"""
_PYTHON = """
unit = line*
line = simple (';' simple)* ';'? NL | compound
suite = line+
body = ':' (I:suite | simple (';' simple)* ';'? NL)
simple = exprs | targets | annotated | 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' (expr ('from' expr)?)? | ('global' | 'nonlocal') ID (',' ID)* | 'del' exprs | 'assert' expr (',' expr)? | 'import' dotted_as (',' dotted_as)* | 'from' dots (dotted)? 'import' ('*' | as_names | P:as_names_in) | 'type' ID (S:tparams)? '=' expr
dots = ('.' | '...')*
dotted = ID ('.' ID)*
dotted_as = dotted ('as' ID)?
as_names = ID ('as' ID)? (',' ID ('as' ID)?)*
as_names_in = ID ('as' ID)?
targets = (exprs '=')+ exprs | post AUG exprs
annotated = post ':' expr ('=' exprs)?
exprs = star (',' star)* ','? | 'yield' exprs? | 'yield' 'from' expr
star = expr | '*' unary_or
unary_or = binary
compound = decorator* 'async'? 'def' ID (S:tparams)? P:params ('->' exprs)? body | decorator* 'class' ID (S:tparams)? (P:args)? body | 'if' named body ('elif' named body)* ('else' body)? | 'while' named body ('else' body)? | 'async'? 'for' exprs 'in' exprs body ('else' body)? | 'try' body (('except' '*'? (exprs ('as' ID)?)? body)+ ('else' body)? ('finally' body)? | 'finally' body) | 'async'? 'with' (item (',' item)* ) body | 'async'? 'with' P:items body | 'match' exprs ':' I:cases
item = expr ('as' post)?
items = expr ('as' post)?
cases = ('case' patterns ('if' named)? body)+
patterns = pattern (',' pattern)* ','?
pattern = '*'? or_pattern ('as' ID)?
or_pattern = pat ('|' pat)*
pat = '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | dotted | dotted P:pat_args | P:pat_seq | S:pat_seq | B:pat_map
pat_args = (ID '=')? pattern
pat_seq = pattern
pat_map = '**' ID | (STR | NUM | '-' NUM | dotted | 'None' | 'True' | 'False') ':' pattern
decorator = '@' named NL
tparams = ('*' | '**')? ID (':' expr)? ('=' expr)?
param = ID (':' star)? ('=' expr)? | '*' (ID (':' star)?)? | '**' ID (':' expr)? | '/'
lparams = lparam (',' lparam)* ','?
lparam = ID ('=' expr)? | '*' ID? | '**' ID | '/'
named = expr | ID ':=' expr
expr = or ('if' or 'else' expr)? | 'lambda' lparams? ':' expr
or = not (('and' | 'or') not)*
not = 'not'* compare
compare = binary (cmp binary)*
cmp = CMP | 'in' | 'not' 'in' | 'is' | 'is' 'not'
binary = unary (BIN unary)*
unary = ('-' | '+' | '~')* power
power = 'await'? post
post = prim suffix*
suffix = '.' ID | P:args | S:subscripts
prim = ID | NUM | STR+ | 'None' | 'True' | 'False' | '...' | P:group | S:elems | B:entries
subscripts = slice
slice = named | expr? ':' expr? (':' expr?)? | '*' binary
group = 'yield' 'from' expr | 'yield' exprs? | (star_named (',' star_named)* ','?)? | star_named comp+
star_named = named | '*' binary
elems = (star_named (',' star_named)* ','?)? | star_named comp+
comp = 'async'? 'for' exprs_in 'in' or ('if' cond)*
cond = or | ID ':=' or | 'lambda' lparams? ':' expr
exprs_in = starred (',' starred)* ','?
starred = '*'? binary
entry = star_named | expr ':' expr | '**' binary | star_named comp+ | expr ':' expr comp+
arg = named comp* | ID '=' expr | '*' expr | '**' expr
"""
_RUBY = """
unit = stmts
stmts = term* (stmt term+)* stmt?
term = NL | ';'
stmt = 'def' ('self' '.')? dname (P:params)? '=' NL? stmt | expr_stmt modifier* | 'alias' (name | STR) (name | STR) | 'undef' name (',' name)*
modifier = ('if' | 'unless' | 'while' | 'until' | 'rescue') expr_stmt
expr_stmt = not_expr (('and' | 'or') NL? not_expr)*
not_expr = 'not'* expr | 'return' cargs? | ('break' | 'next') cargs? | 'yield' cargs?
expr = assign
assign = ternary | lhs (',' lhs)* ','? ASSIGN NL? rhs | ternary '=>' pattern | ternary 'in' pattern
lhs = '*'? post | P:mlhs
mlhs = '*'? post
rhs = assign (',' splat)* | '*' ternary | not_expr 'rescue' expr
splat = '*'? ternary
ternary = range ('?' NL? ternary NL? ':' NL? ternary)?
range = binary (('..' | '...') binary?)? | ('..' | '...') binary
binary = unary (BIN NL? unary)*
unary = PRE unary | 'defined?' unary | post
post = prim suffix* | prim suffix* block
block = D:dobody | B:block_b
suffix = NL? ('.' | '&.') NL? (name ('!')? | P:args) | '::' name | P:args | S:elems | block
command = (ID | KEYCALL | prim suffix* ('.' | '&.') name) cargs
cargs = carg (',' NL? carg)* 
carg = '*'? ternary | '**' ternary | '&' ternary? | (name ':' | STR ':') NL? ternary? | ternary '=>' NL? ternary | command
prim = ID | NUM | STR+ | 'nil' | 'true' | 'false' | 'self' | 'super' | P:paren | S:elems | B:hash | K:body | '->' (P:params | ID (',' ID)*)? (B:block_b | D:dobody) | '::' ID | command | 'redo' | 'retry' | 'defined?' P:args
name = ID | KEYWORD | OPNAME | S:nothing '='? | 'self'
nothing = 
paren = stmts
elems = (NL* carg NL*)?
hash = NL* ((name | STR) ':' NL* (assign)? | assign '=>' NL* assign | '**' ternary) NL*
args = (NL* carg NL*)?
block_b = ('|' bparams '|')? stmts
bparams = (bparam (',' NL? bparam)* ','?)? (';' ID (',' ID)*)?
bparam = '*'? ID ('=' binary_nopipe)? | '&' ID? | '**' (ID | 'nil')? | ID ':' binary_nopipe? | P:bparam_in | '*'
bparam_in = '*'? ID | P:bparam_in
binary_nopipe = unary
params = NL* ('*' ID? | '**' (ID | 'nil')? | '&' ID? | ID ('=' ternary)? | ID ':' ternary? | P:bparam_in | '...') NL*
body = deftop | classtop | iftop | whiletop | casetop | begintop | fortop
deftop = 'def' ('self' '.' | ID '.')? dname (P:params | params (',' params)*)? T:stmts rescues
dname = ID | KEYWORD | OPNAME | ID '=' | S:nothing '='?
rescues = ('rescue' cargs? ('=>' post)? T:stmts)* ('else' T:stmts)? ('ensure' T:stmts)?
classtop = 'class' '::'? ID ('::' ID)* ('<' expr)? T:stmts rescues | 'class' '<<' expr T:stmts | 'module' ID ('::' ID)* T:stmts
iftop = ('if' | 'unless') expr_stmt T:stmts ('elsif' expr_stmt T:stmts)* ('else' T:stmts)?
whiletop = ('while' | 'until') expr_stmt T:stmts
fortop = 'for' ID (',' ID)* 'in' expr T:stmts
casetop = 'case' expr_stmt? T:nothing ('when' cargs T:stmts)+ ('else' T:stmts)? | 'case' expr_stmt T:nothing ('in' pattern ('if' expr)? T:stmts)+ ('else' T:stmts)?
pattern = cargs | pattern '|' cargs
begintop = 'begin' T:stmts rescues
dobody = ('|' bparams '|')? T:stmts rescues
"""
_JSON = """
unit = value
value = STR | NUM | 'true' | 'false' | 'null' | B:obj | S:list
elem = value
prop = STR ':' value
"""

#: (bracket, content rule) that is a list cut at commas: element rule, empty elements, comma at the end.
_COMMA_JS = {("P", "args"): ("arg", False, True), ("P", "params"): ("param", False, True), ("S", "list"): ("elem", True, True), ("B", "obj"): ("prop", False, True), ("B", "names"): ("named", False, True), ("S", "binding_list"): ("binding_list", True, True), ("B", "binding_list"): ("binding_list", False, True), ("P", "type_params"): ("type_params", False, True), ("S", "tuple"): ("tuple", False, True), ("B", "enum"): ("enum", False, True), ("P", "qparams"): ("qparams", False, False), ("S", "qlist"): ("qlist", False, True)}
COMMA = {
    "js": _COMMA_JS, "ts": _COMMA_JS, "qml": _COMMA_JS,
    "java": {("P", "args"): ("arg", False, False), ("P", "params"): ("param", False, False), ("P", "lambda_params"): ("lambda_params", False, False), ("B", "init_list"): ("init", False, True), ("P", "anno"): ("anno", False, False), ("B", "alist"): ("avalue", False, True), ("P", "patterns"): ("patterns", False, False)},
    "go": {("P", "args"): ("arg", False, True), ("P", "params"): ("param", False, True), ("B", "lit"): ("lit", False, True), ("S", "tparam"): ("tparam", False, True), ("S", "type_args"): ("type", False, True)},
    "rust": {("P", "args"): ("arg", False, True), ("P", "params"): ("param", False, True), ("B", "fields"): ("field", False, True), ("P", "tuple_fields"): ("tuple_field", False, True), ("B", "variants"): ("variant", False, True), ("B", "trees"): ("tree", False, True), ("P", "types"): ("types", False, True), ("P", "fn_types"): ("fn_types", False, True), ("P", "patterns"): ("patterns", False, True), ("S", "patterns"): ("patterns", False, True), ("B", "field_pats"): ("field_pats", False, True), ("S", "array_lit"): ("array_lit", False, True), ("B", "struct_lit"): ("struct_lit", False, True)},
    "cpp": {("P", "args"): ("arg", False, False), ("P", "params"): ("param", False, False), ("B", "init_list"): ("init_list", False, True), ("B", "enum"): ("enum", False, True), ("S", "captures"): ("captures", False, False), ("S", "names"): ("names", False, False)},
    "python": {("P", "args"): ("arg", False, True), ("P", "params"): ("param", False, True), ("B", "entries"): ("entry", False, True), ("S", "subscripts"): ("slice", False, True), ("S", "tparams"): ("tparams", False, True), ("P", "as_names_in"): ("as_names_in", False, True), ("P", "items"): ("items", False, True), ("P", "pat_args"): ("pat_args", False, True), ("P", "pat_seq"): ("pat_seq", False, True), ("S", "pat_seq"): ("pat_seq", False, True), ("B", "pat_map"): ("pat_map", False, True), ("S", "elems"): ("elems", False, True), ("P", "group"): ("group", False, True)},
    "ruby": {("P", "args"): ("args", False, True), ("S", "elems"): ("elems", False, True), ("B", "hash"): ("hash", False, True), ("P", "params"): ("params", False, True)},
    "json": {("B", "obj"): ("prop", False, False), ("S", "list"): ("elem", False, False)},
}
#: Content rules that are statement lists, cut into statements first.
STATEMENTS = {
    "js": {"stm": "stm", "class": "class_body"}, "ts": {"stm": "stm", "class": "class_body"}, "qml": {"stm": "stm", "class": "class_body", "qml": "qml"}, "java": {"unit": "unit", "stm": "stm", "class": "class_body"}, "go": {"unit": "unit", "stm": "stm"},
    "rust": {"unit": "unit", "stm": "stm", "items": "items"}, "cpp": {"unit": "unit", "stm": "stm", "class": "class_body"}, "python": {"unit": "unit", "suite": "suite"}, "ruby": {"stmts": "stmts", "unit": "stmts"}, "json": {},
}
UNIT = {"js": "stm", "ts": "stm", "qml": "file", "java": "unit", "go": "unit", "rust": "unit", "cpp": "unit", "python": "unit", "ruby": "stmts", "json": "unit"}
FAMILY = {"jsx": "js", "tsx": "ts"}


def _words(s: str) -> frozenset:
    return frozenset(s.split())


@cache
def grammar(lang: str) -> Grammar:
    """The grammar of a language family, with its token classes."""
    soft = _words(SOFT[{"ts": "js", "qml": "js"}.get(lang, lang)])
    reserved = _words(RESERVED[{"ts": "js", "qml": "js"}.get(lang, lang)])
    c: dict[str, frozenset] = {"ID": frozenset({"ID"}) | soft, "NUM": frozenset({"NUM"}), "STR": frozenset({"STR"}), "NL": frozenset({"NL"}), "KEYWORD": reserved | soft}
    if lang in ("js", "ts", "qml"):
        c |= {"JSX": frozenset({"JSX"}), "BIN": _words(_BINARY + " === !== ** ?? instanceof in |>"), "ASSIGN": _words(_ASSIGN + "**= &&= ||= ??="), "PRE": _words("! - + ~ ++ -- typeof void delete await"), "KEYVALUE": _words("this super null true false")}
        return Grammar({"js": _JS, "ts": _TS, "qml": _QML}[lang].replace("B:class ", "B:class "), c)
    if lang == "java":
        c |= {"BIN": _words(_BINARY), "ASSIGN": _words(_ASSIGN), "PRE": _words("! - + ~ ++ --"), "PRIM": _words("int long short byte char boolean float double void"), "MOD": _words("public private protected static final abstract native synchronized transient volatile strictfp")}
        c["ID"] = frozenset({"ID"}) | soft
        return Grammar(_JAVA, c)
    if lang == "go":
        c |= {"BIN": _words(_BINARY + " &^ <-"), "ASSIGN": _words(_ASSIGN + "&^="), "PRE": _words("! - + ^ * & <-")}
        return Grammar(_GO, c)
    if lang == "rust":
        c |= {"LIFE": frozenset({"LIFE"}), "BIN": _words(_BINARY), "ASSIGN": _words(_ASSIGN), "PRE": _words("! - *")}
        return Grammar(_RUST, c)
    if lang == "cpp":
        ops = _words(_BINARY + " " + _ASSIGN + "! ~ ++ -- -> ->* , <=> && ||")
        c |= {"PP": frozenset({"PP"}), "BIN": _words(_BINARY + " <=> .* ->*"), "ASSIGN": _words(_ASSIGN), "PRE": _words("! - + ~ ++ -- * & && co_await"), "PRIM": _words("int long short char bool float double void signed unsigned wchar_t char8_t char16_t char32_t"), "CASTS": _words("static_cast dynamic_cast const_cast reinterpret_cast"), "OPERATOR": ops}
        return Grammar(_CPP, c)
    if lang == "python":
        c |= {"BIN": _words("+ - * / % // ** @ << >> & | ^"), "CMP": _words("== != < > <= >="), "AUG": _words("+= -= *= /= //= %= **= @= &= |= ^= >>= <<=")}
        return Grammar(_PYTHON, c)
    if lang == "ruby":
        c |= {
            "BIN": _words(_BINARY + " >> ** === =~ !~ <=>"), "ASSIGN": _words("= += -= *= /= %= **= &= |= ^= <<= >>= &&= ||="), "PRE": _words("! - + ~ * & **"),
            "KEYCALL": _words("super yield"), "OPNAME": _words("+ - * / % == != < > <= >= << >> ** === =~ <=> ! ~ & | ^"),
        }
        return Grammar(_RUBY, c)
    return Grammar(_JSON, c)
