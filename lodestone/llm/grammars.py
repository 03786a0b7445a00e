"""Token-level grammars, written from the public language references, for the derivative engine.

Context flags of JS/TS: R return allowed, A await, Y yield, L loop, B break, N no ``in``, 0 left edge of a statement,
T TypeScript (fixed).  NLB is a bracket behind a line break, which ends a type.  None of the rules is left-recursive.
"""

JS = r"""
module: item*
item: import_decl | export_decl | ^stmt | decl
semi: ';' | ASI
lb: '[' | NLB
ident: NAME | 'async' | 'of' | 'get' | 'set' | 'from' | 'as' | 'meta' | 'target' | ?T 'type' | ?T 'declare' | ?T 'namespace' | ?T 'module' | ?T 'abstract' | ?T 'readonly' | ?T 'keyof' | ?T 'infer' | ?T 'unique' | ?T 'is' | ?T 'asserts' | ?T 'satisfies' | ?T 'override' | ?T 'accessor' | ?T 'global' | ?T 'require' | ?T 'out'
kw: 'break' | 'case' | 'catch' | 'class' | 'const' | 'continue' | 'debugger' | 'default' | 'delete' | 'do' | 'else' | 'enum' | 'export' | 'extends' | 'false' | 'finally' | 'for' | 'function' | 'if' | 'import' | 'in' | 'instanceof' | 'new' | 'null' | 'return' | 'super' | 'switch' | 'this' | 'throw' | 'true' | 'try' | 'typeof' | 'var' | 'void' | 'while' | 'with' | 'let' | 'static' | 'yield' | 'await' | 'implements' | 'interface' | 'package' | 'private' | 'protected' | 'public'
word: ident | kw

stmt: block | 'var' vars semi | ';' | 'if' '(' expr<-N> ')' stmt [ 'else' stmt ]
  | 'do' stmt<+LB> 'while' '(' expr ')' [ ';' ] | 'while' '(' expr ')' stmt<+LB>
  | 'for' '(' forhead ')' stmt<+LB> | ?A 'for' 'await' '(' fordecl 'of' ae ')' stmt<+LB>
  | ?L 'continue' [ ident ] semi | 'break' ident semi | ?B 'break' semi | ?R 'return' [ expr ] semi
  | 'switch' '(' expr ')' '{' case* [ 'default' ':' stmts<+B> case* ] '}'
  | 'throw' expr semi | 'try' block ( catch [ 'finally' block ] | 'finally' block ) | 'debugger' semi
  | ident ':' stmt | expr<+0> semi
stmts: ( stmt | decl )*
block: '{' stmts '}'
case: 'case' expr ':' stmts<+B>
catch: 'catch' [ '(' bind [ ?T ann ] ')' ] block
forhead: [ 'var' vars<+N> | 'let' vars<+N> | 'const' cvars<+N> | expr<+N> ] ';' [ expr ] ';' [ expr ] | fordecl ( 'in' expr | 'of' ae )
fordecl: ( 'var' | 'let' | 'const' ) bind [ ?T ann ] | lhst
vars: vardecl ( ',' vardecl )*
vardecl: ident [ ?T [ '!' ] ann ] [ init ] | pattern [ ?T ann ] init
cvars: cvardecl ( ',' cvardecl )*
cvardecl: ident [ ?T ann ] init | pattern [ ?T ann ] init
init: '=' ae
decl: 'let' vars semi | 'const' cvars semi | func | class_decl | ?T tsdecl
func: 'function' ident fsig ( '{' stmts<=R> '}' | ?T semi ) | 'function' '*' ident fsig '{' stmts<=RY> '}'
  | 'async' 'function' ident fsig ( '{' stmts<=RA> '}' | ?T semi ) | 'async' 'function' '*' ident fsig '{' stmts<=RAY> '}'
func_expr: 'function' [ ident ] fsig '{' stmts<=R> '}' | 'function' '*' [ ident ] fsig '{' stmts<=RY> '}'
  | 'async' 'function' [ ident ] fsig '{' stmts<=RA> '}' | 'async' 'function' '*' [ ident ] fsig '{' stmts<=RAY> '}'
fsig: [ ?T typeparams ] '(' params<-N> ')' [ ?T ret ]
params: [ param ( ',' param )* [ ',' [ rest ] ] | rest ]
param: ?~T bind [ init ] | ?T decorator* tmod* ( bind | 'this' ) [ '?' ] [ ann ] [ init ]
tmod: 'public' | 'private' | 'protected' | 'readonly' | 'override'
rest: '...' bind [ ?T ann ]
bind: ident | pattern
pattern: '{' [ bprop ( ',' bprop )* [ ',' [ '...' ident ] ] | '...' ident ] '}' | lb [ belem ] ( ',' [ belem ] )* ']'
bprop: ident [ init<-N> ] | propname ':' bind [ init<-N> ]
belem: bind [ init<-N> ] | '...' bind
propname: word | STRING | NUMBER | lb ae<-N> ']'

class_decl: decorator* [ ?T 'abstract' ] 'class' ident class_tail
class_expr: decorator* 'class' [ ident ] class_tail
class_tail: [ ?T typeparams ] [ 'extends' lhs [ ?T typeargs ] ] [ ?T 'implements' typelist ] '{' member* '}'
decorator: ?T '@' lhs
cmod: 'static' | ?T tmod | ?T 'abstract' | ?T 'declare' | ?T 'accessor'
member: ';' | 'static' '{' stmts<=> '}' | decorator* cmod* ( method | field )
method: cname [ ?T '?' ] fsig mbody<=R> | '*' cname fsig mbody<=RY> | 'async' cname fsig mbody<=RA> | 'async' '*' cname fsig mbody<=RAY>
  | 'get' cname '(' ')' [ ?T ret ] mbody<=R> | 'set' cname '(' param [ ',' ] ')' mbody<=R>
mbody: '{' stmts '}' | ?T semi
field: cname [ ?T ( '?' | '!' ) ] [ ?T ann ] [ '=' ae<=> ] semi | ?T lb ident ':' type ']' ann semi
cname: propname | PRIVATE

import_decl: 'import' STRING [ withattr ] semi | 'import' [ ?T 'type' ] iclause 'from' STRING [ withattr ] semi | ?T 'import' [ 'type' ] ident '=' ( 'require' '(' STRING ')' | tname ) semi
withattr: 'with' '{' [ propname ':' STRING ( ',' propname ':' STRING )* [ ',' ] ] '}'
iclause: ident [ ',' ( ins | inamed ) ] | ins | inamed
ins: '*' 'as' ident
inamed: '{' [ ispec ( ',' ispec )* [ ',' ] ] '}'
ispec: [ ?T 'type' ] ( ident | ( word | STRING ) 'as' ident )
espec: [ ?T 'type' ] ( word | STRING ) [ 'as' ( word | STRING ) ]
export_decl: 'export' ( [ ?T 'type' ] '*' [ 'as' ( word | STRING ) ] 'from' STRING [ withattr ] semi
  | [ ?T 'type' ] '{' [ espec ( ',' espec )* [ ',' ] ] '}' [ 'from' STRING [ withattr ] ] semi
  | decl | 'var' vars semi | 'default' ( func_default | class_default | ae<+0> semi | ?T 'abstract' 'class' [ ident ] class_tail | ?T interface ) | ?T '=' ae semi | ?T 'as' 'namespace' ident semi | ?T import_decl )
func_default: 'function' [ ident ] fsig ( '{' stmts<=R> '}' | ?T semi ) | 'function' '*' [ ident ] fsig '{' stmts<=RY> '}'
  | 'async' 'function' [ ident ] fsig '{' stmts<=RA> '}' | 'async' 'function' '*' [ ident ] fsig '{' stmts<=RAY> '}'
class_default: decorator* 'class' [ ident ] class_tail

expr: ^ae ( ',' ae )*
ae: ^lhs [ '++' | '--' ] bintail | ^lhst asg ae | prefixed bintail | arrow | ?Y 'yield' [ [ '*' ] ae ]
  | ?T typeassert bintail
asg: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>>=' | '>>>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??=' | ?T GTJ GTJ '=' | ?T GTJ GTJ GTJ '='
prefixed: ( '!' | '~' | '+' | '-' | 'typeof' | 'void' | 'delete' | '++' | '--' ) unary | ?A 'await' unary | ?T typeassert
unary: lhs [ '++' | '--' ] | prefixed
typeassert: '<' type gt unary
bintail: ( binop unary | ?T ( 'as' | 'satisfies' ) ( type | 'const' ) )* [ '?' ae<-N> ':' ae ]
binop: '||' | '&&' | '??' | '|' | '^' | '&' | '==' | '!=' | '===' | '!==' | '<' | '<=' | 'instanceof' | ?~N 'in' | '<<' | '+' | '-' | '*' | '/' | '%' | '**'
  | ?~T '>' | ?~T '>=' | ?~T '>>' | ?~T '>>>' | ?T '>' | ?T GTJ '=' | ?T GTJ '>' | ?T GTJ GTJ '>'
lhs: ^primary suffix*
lhst: ^primary suffix* ( '.' ( word | PRIVATE ) | lb expr<-N> ']' | ?T '!' ) | ident | arr | ?~0 obj | '(' lhst ')'
  | ?T '(' lhst ( 'as' | 'satisfies' ) type ')'
suffix: '.' ( word | PRIVATE ) | '?.' ( word | PRIVATE | lb expr<-N> ']' | args | ?T typeargs args ) | lb expr<-N> ']' | args | template | ?T '!' | ?T typeargs [ args | template ]
primary: ident | 'this' | 'super' | 'null' | 'true' | 'false' | NUMBER | STRING | REGEX | template | '(' expr<-N> ')' | arr | ?~0 obj | ?~0 func_expr | ?~0 class_expr
  | 'new' primary | 'new' '.' 'target' | 'import' '(' ae<-N> [ ',' [ ae<-N> [ ',' ] ] ] ')' | 'import' '.' 'meta' | PRIVATE
template: TPL | THEAD expr<-N> ( TMID expr<-N> )* TTAIL
args: '(' [ arg<-N> ( ',' arg<-N> )* [ ',' ] ] ')'
arg: [ '...' ] ae
arr: lb [ arg<-N> ] ( ',' [ arg<-N> ] )* ']'
obj: '{' [ prop<-N> ( ',' prop<-N> )* [ ',' ] ] '}'
prop: '...' ae | ident [ init ] | propname ':' ae | propname fsig '{' stmts<=R> '}' | '*' propname fsig '{' stmts<=RY> '}' | 'async' propname fsig '{' stmts<=RA> '}' | 'async' '*' propname fsig '{' stmts<=RAY> '}'
  | 'get' propname '(' ')' [ ?T ret ] '{' stmts<=R> '}' | 'set' propname '(' param [ ',' ] ')' '{' stmts<=R> '}'
arrow: ( ident | [ ?T typeparams ] '(' params<-N> ')' [ ?T ret ] ) '=>' ( '{' stmts<=R> '}' | ae<+0-A> )
  | 'async' ( ident | [ ?T typeparams ] '(' params<-N> ')' [ ?T ret ] ) '=>' ( '{' stmts<=RA> '}' | ae<+0A> )

gt: '>' | GTJ
ann: ':' type
ret: ':' ( type | predicate )
predicate: 'asserts' ( ident | 'this' ) [ 'is' type ] | ( ident | 'this' ) 'is' type
type: utype [ 'extends' utype '?' type ':' type ] | ftype
ftype: [ 'abstract' ] [ 'new' ] [ typeparams ] '(' params ')' '=>' ( type | predicate )
utype: [ '|' | '&' ] ptype ( ( '|' | '&' ) ( ptype | ftype ) )*
ptype: ( 'keyof' | 'unique' | 'readonly' ) ptype | 'infer' ident [ 'extends' utype ] | atype ( '[' [ type ] ']' )*
atype: tname [ typeargs ] | 'this' | 'void' | 'null' | 'true' | 'false' | [ '-' ] NUMBER | STRING | TPL | THEAD type ( TMID type )* TTAIL
  | 'typeof' ( ident | 'this' | 'import' '(' STRING ')' ) ( '.' word )* [ typeargs ] | 'import' '(' STRING ')' ( '.' word )* [ typeargs ] | '(' type ')'
  | '{' tmember* '}' | mapped | lb [ telem ( ',' telem )* [ ',' ] ] ']'
telem: [ '...' ] [ word [ '?' ] ':' ] type [ '?' ]
mapped: '{' [ [ '+' | '-' ] 'readonly' ] lb ident 'in' type [ 'as' type ] ']' [ [ '+' | '-' ] '?' ] [ ann ] [ ';' | ',' | ASI ] '}'
tname: ident ( '.' word )*
typelist: tname [ typeargs ] ( ',' tname [ typeargs ] )*
typeargs: '<' type ( ',' type )* gt
typeparams: '<' typeparam ( ',' typeparam )* [ ',' ] '>'
typeparam: ( 'const' | 'in' | 'out' )* ident [ 'extends' type ] [ '=' type ]
tmember: ( 'readonly' | 'get' | 'set' )* propname [ '?' ] ( [ ann ] | tsig ) tsep | tsig tsep | 'new' tsig tsep | [ 'readonly' ] lb ident ':' type ']' ann tsep
tsig: [ typeparams ] '(' params ')' [ ret ]
tsep: ';' | ',' | ASI
interface: 'interface' ident [ typeparams ] [ 'extends' typelist ] '{' tmember* '}'
enum: [ 'const' ] 'enum' ident '{' [ enumm ( ',' enumm )* [ ',' ] ] '}'
enumm: propname [ init ]
tsdecl: interface | 'type' ident [ typeparams ] '=' type semi | enum | 'declare' tsambient | ( 'namespace' | 'module' ) ( tname | STRING ) '{' item* '}'
tsambient: decl | 'var' vars semi | 'const' ident ann semi | ( 'namespace' | 'module' | 'global' ) [ tname | STRING ] ( '{' item* '}' | semi )
"""

PY = r"""
file: ( NEWLINE | statement )*
statement: compound | simples
simples: simple ( ';' simple )* [ ';' ] NEWLINE
block: simples | NEWLINE INDENT statement+ DEDENT
id: NAME | 'match' | 'case' | 'type'
simple: star_exprs | ( targets '=' )+ ( yield | star_exprs ) | single augop ( yield | star_exprs ) | ann_target ':' expr [ '=' ( yield | star_exprs ) ] | yield
  | 'pass' | 'break' | 'continue' | 'return' [ star_exprs ] | 'raise' [ expr [ 'from' expr ] ] | ( 'global' | 'nonlocal' ) id ( ',' id )*
  | 'del' del_t ( ',' del_t )* [ ',' ] | 'assert' expr [ ',' expr ] | import | 'type' id [ tparams ] '=' expr
augop: '+=' | '-=' | '*=' | '@=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '**=' | '//='
import: 'import' dotted [ 'as' id ] ( ',' dotted [ 'as' id ] )*
  | 'from' ( ( '.' | '...' )* dotted | ( '.' | '...' )+ ) 'import' ( '*' | iname ( ',' iname )* | '(' iname ( ',' iname )* [ ',' ] ')' )
dotted: id ( '.' id )*
iname: id [ 'as' id ]
targets: target ( ',' target )* [ ',' ]
target: [ '*' ] tatom
tatom: member_t | id | '(' [ targets ] ')' | '[' [ targets ] ']'
member_t: atom trailer* ( '.' id | '[' slices ']' )
single: member_t | id | '(' single ')'
ann_target: single
del_t: member_t | id | '(' [ del_t ( ',' del_t )* [ ',' ] ] ')' | '[' [ del_t ( ',' del_t )* [ ',' ] ] ']'

compound: decorators | funcdef | classdef | 'if' named ':' block ( 'elif' named ':' block )* [ 'else' ':' block ] | with | for | try | 'while' named ':' block [ 'else' ':' block ] | match
  | 'async' ( funcdef | with | for )
decorators: ( '@' named NEWLINE )+ ( funcdef | classdef | 'async' funcdef )
funcdef: 'def' id [ tparams ] '(' [ params ] ')' [ '->' expr ] ':' block
classdef: 'class' id [ tparams ] [ '(' [ cargs ] ')' ] ':' block
for: 'for' targets 'in' star_exprs ':' block [ 'else' ':' block ]
with: 'with' ( witem ( ',' witem )* | '(' witem ( ',' witem )* [ ',' ] ')' ) ':' block
witem: expr [ 'as' target ]
try: 'try' ':' block ( ( 'except' [ expr [ 'as' id ] ] ':' block )+ [ 'else' ':' block ] [ 'finally' ':' block ] | 'finally' ':' block | ( 'except' '*' expr [ 'as' id ] ':' block )+ [ 'else' ':' block ] [ 'finally' ':' block ] )
tparams: '[' tparam ( ',' tparam )* [ ',' ] ']'
tparam: id [ ':' expr ] [ '=' expr ] | '*' id [ '=' [ '*' ] expr ] | '**' id [ '=' expr ]
params: pplain ( ',' pplain )* [ ',' [ pslash | ppdef_tail | pstar ] ] | pdef ( ',' pdef )* [ ',' [ pslash2 | pstar ] ] | pstar
ppdef_tail: pdef ( ',' pdef )* [ ',' [ pslash2 | pstar ] ]
pslash: '/' [ ',' [ pplain ( ',' pplain )* [ ',' [ pdef ( ',' pdef )* [ ',' [ pstar ] ] | pstar ] ] | pdef ( ',' pdef )* [ ',' [ pstar ] ] | pstar ] ]
pslash2: '/' [ ',' [ pdef ( ',' pdef )* [ ',' [ pstar ] ] | pstar ] ]
pplain: id [ ':' expr ]
pdef: id [ ':' expr ] '=' expr
pany: id [ ':' expr ] [ '=' expr ]
pstar: '*' id [ ':' [ '*' ] expr ] ( ',' pany )* [ ',' [ pkw ] ] | '*' ( ',' pany )+ [ ',' [ pkw ] ] | pkw
pkw: '**' id [ ':' expr ] [ ',' ]
lambda: 'lambda' [ lparams ] ':' expr
lparams: id ( ',' id )* [ ',' [ lslash | lpdef_tail | lstar ] ] | ldef ( ',' ldef )* [ ',' [ lslash2 | lstar ] ] | lstar
lpdef_tail: ldef ( ',' ldef )* [ ',' [ lslash2 | lstar ] ]
lslash: '/' [ ',' [ id ( ',' id )* [ ',' [ ldef ( ',' ldef )* [ ',' [ lstar ] ] | lstar ] ] | ldef ( ',' ldef )* [ ',' [ lstar ] ] | lstar ] ]
lslash2: '/' [ ',' [ ldef ( ',' ldef )* [ ',' [ lstar ] ] | lstar ] ]
ldef: id '=' expr
lany: id [ '=' expr ]
lstar: '*' id ( ',' lany )* [ ',' [ lkw ] ] | '*' ( ',' lany )+ [ ',' [ lkw ] ] | lkw
lkw: '**' id [ ',' ]

match: 'match' subject ':' NEWLINE INDENT case+ DEDENT
subject: star_named ',' [ star_named ( ',' star_named )* [ ',' ] ] | named
case: 'case' ( opat | patterns ) [ 'if' named ] ':' block
patterns: mspat ',' [ mspat ( ',' mspat )* [ ',' ] ]
mspat: '*' id | opat
opat: cpat ( '|' cpat )* [ 'as' id ]
cpat: id | [ '-' ] NUMBER [ ( '+' | '-' ) NUMBER ] | strings | 'None' | 'True' | 'False' | id ( '.' id )+ | '(' [ opat | patterns ] ')' | '[' [ mspat ( ',' mspat )* [ ',' ] ] ']'
  | '{' [ mpitem ( ',' mpitem )* [ ',' ] ] '}' | id ( '.' id )* '(' [ kpat ( ',' kpat )* [ ',' ] ] ')'
kpat: opat | id '=' opat
mpitem: '**' id | ( [ '-' ] NUMBER [ ( '+' | '-' ) NUMBER ] | strings | 'None' | 'True' | 'False' | id ( '.' id )+ ) ':' opat

yield: 'yield' [ 'from' expr | star_exprs ]
star_exprs: star_expr ( ',' star_expr )* [ ',' ]
star_expr: '*' bitor | expr
star_named: '*' bitor | named
named: id ':=' expr | expr
expr: disj [ 'if' disj 'else' expr ] | lambda
disj: notx ( ( 'and' | 'or' ) notx )*
notx: 'not'* cmp
cmp: bitor ( cmpop bitor )*
cmpop: '==' | '!=' | '<' | '>' | '<=' | '>=' | 'in' | 'not' 'in' | 'is' [ 'not' ]
bitor: factor ( ( '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' ) factor )*
factor: ( '+' | '-' | '~' )* [ 'await' ] atom trailer*
trailer: '.' id | '(' [ args ] ')' | '[' slices ']'
slices: slice ( ',' slice )* [ ',' ]
slice: [ expr ] ':' [ expr ] [ ':' [ expr ] ] | named | '*' bitor
atom: id | 'True' | 'False' | 'None' | '...' | NUMBER | strings | '(' [ yield | named compfor | star_named ( ',' star_named )* [ ',' ] ] ')' | '[' [ named compfor | star_named ( ',' star_named )* [ ',' ] ] ']'
  | '{' [ ditem ( ',' ditem )* [ ',' ] | expr ':' expr compfor | star_named ( ',' star_named )* [ ',' ] | named compfor ] '}'
ditem: '**' bitor | expr ':' expr
compfor: ( [ 'async' ] 'for' targets 'in' disj ( 'if' disj_or_named )* )+
disj_or_named: disj | id ':=' expr
args: named compfor | cargs
cargs: posarg ( ',' posarg )* [ ',' [ kwargs ] ] | kwargs
posarg: '*' expr | named
kwargs: kw1 ( ',' kw1 )* [ ',' [ kw2s ] ] | kw2s
kw1: id '=' expr | '*' expr
kw2s: kw2 ( ',' kw2 )* [ ',' ]
kw2: id '=' expr | '**' expr
strings: string+ | BYTES+
string: STRING | FSTART fpart* FEND
fpart: FMID | '{' ( yield | star_exprs ) [ '=' ] [ '!' NAME ] [ ':' fpart* ] '}'
"""

TOML = r"""
doc: line*
line: NL | keyval NL | table NL
keyval: key '=' value
key: simplekey ( '.' simplekey )*
simplekey: BARE | STRING
table: '[' key ']' | '[[' key ']]'
value: STRING | MLSTRING | SCALAR | array | inline
array: '[' NL* [ value NL* ( ',' NL* value NL* )* [ ',' NL* ] ] ']'
inline: '{' [ keyval ( ',' keyval )* ] '}'
"""
