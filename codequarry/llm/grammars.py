"""Grammars of the supported languages in the notation of `gll`, written for recognition.

`ID`, `NUM`, `STR`, `TPL`, `RE` are token classes. Operator precedence is left out, for it
does not matter to whether a text parses.
"""

from __future__ import annotations

#: Reserved words by language; contextual words may also be names.
RESERVED = {
    "javascript": "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false yield await",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while null true false",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "python": "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield None True False",
    "json": "true false null",
}
CONTEXTUAL = {
    "javascript": "of async get set static from as let using accessor",
    "typescript": "of async get set static from as let using accessor global type interface namespace module declare readonly abstract keyof infer is satisfies enum public private protected implements override unique asserts out",
    "java": "var record sealed permits yield non when",
    "go": "",
    "python": "match case type print exec",
    "json": "",
}

JS = """
Stmts = Stmt*
End = ';' | 'U' | EOF
Stmt = ';' | 'U' | B:Stmts | VarDecl End | Func | Class | 'if' P:Exprs 'U'? Stmt ('U'? 'else' Stmt)? | 'for' 'await'? P:ForHead 'U'? Stmt | 'while' P:Exprs 'U'? Stmt | 'do' Stmt 'while' P:Exprs End? | 'return' Exprs? End | 'break' ID? End | 'continue' ID? End | 'throw' Exprs End | 'try' B:Stmts Handler | 'switch' P:Exprs B:Cases | ID ':' Stmt | 'debugger' End | Import | Export | Exprs End | 'with' P:Exprs Stmt | TsStmt
Handler = 'catch' P:CatchParam? B:Stmts ('finally' B:Stmts)? | 'finally' B:Stmts
CatchParam = Binding TypeAnn?
VarDecl = ('var' | 'const' | 'let' | 'await'? 'using') Declarator (',' Declarator)*
Declarator = Binding '!'? TypeAnn? ('=' Expr)?
Binding = ID | S:BindArr | B:BindObj
BindArr = (','* BindElem)* ','*
BindElem = '...'? Binding ('=' Expr)? (',' | EOF)
BindObj = (BindProp (',' BindProp)*)? ','?
BindProp = '...' ID | PropName (':' Binding)? ('=' Expr)?
ForHead = ('var' | 'const' | 'let' | 'await'? 'using') Binding ('of' | 'in') Exprs | Postfix ('of' | 'in') Exprs | (VarDecl | Exprs)? ';' Exprs? ';' Exprs?
Cases = Case*
Case = ('case' Exprs | 'default') ':' Stmts
Func = 'async'? 'function' '*'? ID? Sig (B:Stmts | End)
Sig = TypeParams? P:Params TypeAnn?
Params = (Param (',' Param)*)? ','?
Param = Decorator* ParamMod* '...'? (Binding | 'this') '?'? TypeAnn? ('=' Expr)?
Class = Decorator* 'class' ID? TypeParams? ('extends' Postfix TypeArgs?)? Impl? B:Members
Members = Member*
Member = ';' | 'U' | Decorator* Mod* PropName ('?' | '!')? Sig (B:Stmts | End) | Decorator* Mod* '*'? PropName Sig B:Stmts | Decorator* Mod* PropName ('?' | '!')? TypeAnn? ('=' Expr)? End | Decorator* Mod* PropName ('?' | '!')? TypeAnn? '=' 'async'? (ID | TypeParams? P:Params TypeAnn?) '=>' B:Stmts | 'static' B:Stmts | Index
Mod = 'static' | 'async' | 'get' | 'set' | 'accessor' | '*' | TsMod
Decorator = '@' Postfix 'U'?
PropName = Name | STR | NUM | S:Expr | '#' Name
Name = ID | Keyword
Object = (Prop (',' Prop)*)? ','?
Prop = '...' Expr | PropName ':' Expr | ID ('=' Expr)? | ('async' | 'get' | 'set' | '*')* PropName Sig B:Stmts
Import = 'import' STR End | 'import' TypeKw? ImportClause 'from' STR (With B:Object)? End
ImportClause = ID (',' (B:Specs | '*' 'as' ID))? | B:Specs | '*' 'as' ID
With = 'with'
Specs = (Spec (',' Spec)*)? ','?
Spec = TypeKw? (Name | STR) ('as' (Name | STR))?
Export = 'export' (VarDecl End | Func | Class | 'default' (Func | Class | Expr End) | TypeKw? '*' ('as' (Name | STR))? 'from' STR (With B:Object)? End | TypeKw? B:Specs ('from' STR (With B:Object)?)? End | TsStmt | '=' Expr End)
Exprs = Expr (',' Expr)*
Expr = Unary (Bin Unary)* ('?' Expr ':' Expr)? | Arrow | 'yield' '*'? Expr?
Bin = 'o' | 'A' | '=' | '+' | '-' | '*' | '/' | '%' | '&' | '^' | '<' | '>' 'U'? | '>' '>' | '>' '>' '>' | '<' '<' | 'in' | 'instanceof' | '|'
Arrow = 'async'? (ID | TypeParams? P:Params TypeAnn?) '=>' (B:Stmts | Expr)
Unary = Prefix* Postfix 'I'? | Prefix* Arrow | Prefix+ 'yield' Expr?
Prefix = '!' | '~' | '+' | '-' | 'I' | 'typeof' | 'void' | 'delete' | 'await' | 'new'
Postfix = Primary Suffix*
Suffix = '.' '#'? Name | '?.' ('#'? Name | S:Exprs | P:Args | Template) | 'U'? S:Exprs | P:Args | Template | TsSuffix
Args = (Arg (',' Arg)*)? ','?
Arg = '...'? Expr
Template = TPL (B:Exprs TPL)*
Primary = ID | NUM | STR | RE | Template | 'this' | 'super' | 'null' | 'true' | 'false' | P:Exprs | S:Array | B:Object | 'async'? 'function' '*'? ID? Sig B:Stmts | Class | 'new' '.' ID | 'import' ('.' ID)? | '#' Name
Array = (','* ArrElem)* ','*
ArrElem = '...'? Expr (',' | EOF)
"""

#: Nonterminals that only the typed dialect fills.
TS_ONLY = """
TypeAnn = ':' Returned
Returned = 'asserts'? (ID | 'this') 'is' Type | 'asserts' (ID | 'this') | Type
TypeParams = '<' TypeParam (',' TypeParam)* ','? '>'
TypeParam = 'const'? ('in' | 'out')* ID ('extends' Type)? ('=' Type)?
TypeArgs = '<' Type (',' Type)* '>'
ParamMod = 'public' | 'private' | 'protected' | 'readonly' | 'override'
TsMod = 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'declare' | 'override'
TypeKw = 'type' | 'typeof'
Impl = 'implements' Type (',' Type)*
Index = ('readonly' | 'static')* S:IndexSig TypeAnn End
IndexSig = ID TypeAnn
TsStmt = 'type' ID TypeParams? '=' Type End | 'interface' ID TypeParams? ('extends' Type (',' Type)*)? B:TypeBody | 'const'? 'enum' ID B:Enum | 'declare' Stmt | 'global' B:Stmts | ('namespace' | 'module') (ID ('.' ID)* | STR) B:Stmts | 'abstract' Class | 'import' ID '=' Expr End
Enum = (EnumItem (',' EnumItem)*)? ','?
EnumItem = PropName ('=' Expr)?
TsSuffix = '!' | ('as' | 'satisfies') Type | ('as' 'const') | TypeArgs (P:Args | Template)
Type = ('|' | '&')? TypeU (('|' | '&') TypeU)* ('extends' Type '?' Type ':' Type)?
TypeU = ('keyof' | 'readonly' | 'typeof' | 'infer' | 'unique')* TypeP S:TypeIdx*
TypeIdx = Type?
TplType = TPL (B:TypeIdx TPL)*
TypeP = ID ('.' Name)* TypeArgs? | 'void' | 'null' | 'this' | 'true' | 'false' | STR | '-'? NUM | TplType | B:TypeBody | S:TypeList | P:Type | 'abstract'? 'new'? TypeParams? P:Params '=>' Returned | 'import' P:Args ('.' Name)* TypeArgs?
TypeList = (TypeItem (',' TypeItem)*)? ','?
TypeItem = '...'? (ID '?'? ':')? Type '?'?
TypeBody = TypeMember*
TypeMember = (';' | ',' | 'U') | TMod* PropName '?'? (TypeAnn | Sig)? (TEnd | S:IndexSig TypeAnn TEnd) | TMod* 'new'? Sig TEnd | TMod* S:IndexSig TypeAnn TEnd | ('+' | '-')? 'readonly'? S:Mapped ('+' | '-')? '?'? TypeAnn TEnd
TMod = 'readonly' | 'get' | 'set'
Mapped = ID 'in' Type ('as' Type)?
TEnd = ';' | ',' | 'U' | EOF
"""

JAVA = """
Top = TopItem*
TopItem = ';' | Mods 'package' QName ';' | 'import' 'static'? QName ('.' '*')? ';' | Decl | Mods ID? 'module' QName B:Directives
Directives = Directive*
Directive = ID 'static'? ID? QName (ID QName (',' QName)*)? ';'
Decl = Mods (ClassHead B:Members | 'enum' ID Impl? B:Enum | '@' 'interface' ID B:Members | 'record' ID TypeParams? P:Params Impl? B:Members)
ClassHead = ('class' | 'interface') ID TypeParams? ('extends' Types)? Impl? ('permits' Types)?
Impl = 'implements' Types
Types = Type (',' Type)*
Mods = (Annotation | 'public' | 'protected' | 'private' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed')*
Annotation = '@' QName P:AnnArgs?
AnnArgs = (AnnArg (',' AnnArg)*)?
AnnArg = (ID '=')? AnnVal
AnnVal = Expr | Annotation | B:AnnVals
AnnVals = (AnnVal (',' AnnVal)*)? ','?
QName = ID ('.' ID)*
Prim = 'int' | 'long' | 'short' | 'byte' | 'char' | 'boolean' | 'float' | 'double' | 'void'
Type = Annotation* (Prim | ID TypeArgs? ('.' ID TypeArgs?)*) S:Empty*
Empty = EOF
TypeArgs = '<' (TypeArg (',' TypeArg)*)? '>'
TypeArg = Type | '?' (('extends' | 'super') Type)?
TypeParams = '<' TypeParam (',' TypeParam)* '>'
TypeParam = Annotation* ID ('extends' Type ('&' Type)*)?
Params = (Param (',' Param)*)?
Param = Mods Type '...'? (ID | 'this') S:Empty*
Members = Member*
Member = ';' | 'static'? B:Stmts | Decl | Mods TypeParams? Type ID P:Params S:Empty* Throws? (B:Stmts | ';' | 'default' AnnVal ';') | Mods TypeParams? ID P:Params Throws? B:Stmts | Mods ID B:Stmts | Mods Type Vars ';'
Throws = 'throws' Types
Vars = Var (',' Var)*
Var = ID S:Empty* ('=' VarInit)?
VarInit = Expr | B:ArrInit
ArrInit = (VarInit (',' VarInit)*)? ','?
Enum = (Const (',' Const)*)? ','? (';' Members)?
Const = Annotation* ID P:Args? B:Members?
Stmts = Stmt*
Stmt = B:Stmts | ';' | Mods Type Vars ';' | Decl | 'if' P:Expr Stmt ('else' Stmt)? | 'for' P:ForHead Stmt | 'while' P:Expr Stmt | 'do' Stmt 'while' P:Expr ';' | 'return' Expr? ';' | 'throw' Expr ';' | 'break' ID? ';' | 'continue' ID? ';' | 'yield' Expr ';' | 'try' Try | 'switch' P:Expr B:Cases | 'synchronized' P:Expr B:Stmts | ID ':' Stmt | 'assert' Expr (':' Expr)? ';' | Expr ';'
Try = P:Res B:Stmts Catch* Finally? | B:Stmts Catch+ Finally? | B:Stmts Finally
Catch = 'catch' P:CatchParam B:Stmts
Finally = 'finally' B:Stmts
CatchParam = Mods Type ('|' Type)* ID
Res = ResItem (';' ResItem)* ';'?
ResItem = Mods Type ID '=' Expr | Expr
ForHead = (Mods Type Vars | Exprs)? ';' Expr? ';' Exprs? | Mods Type ID ':' Expr
Exprs = Expr (',' Expr)*
Cases = (OldCase | NewCase)*
OldCase = ('case' Labels | 'default') ':' Stmts
NewCase = ('case' Labels | 'default') '->' (Expr ';' | B:Stmts | 'throw' Expr ';')
Labels = Label (',' Label)* ('when' Expr)?
Label = Expr | 'default' | Pattern
Pattern = Mods Type ID | Type P:Patterns ID?
Patterns = (Pattern (',' Pattern)*)?
Expr = Operand (Bin Operand | 'instanceof' (Type | Pattern))* ('?' Expr ':' Expr)? | Lambda
Bin = 'o' | 'A' | '=' | '+' | '-' | '*' | '/' | '%' | '&' | '^' | '|' | '<' | '>' | '>' '>' | '>' '>' '>' | '<' '<'
Lambda = (ID | P:LambdaParams) '->' (Expr | B:Stmts)
LambdaParams = Params | (ID (',' ID)*)?
Operand = Prefix* Postfix 'I'? | Prefix* P:Cast Operand | Prefix* P:Cast Lambda
Prefix = '+' | '-' | '!' | '~' | 'I'
Cast = Type ('&' Type)*
Postfix = Primary Suffix*
Suffix = '.' TypeArgs? (ID | 'class' | 'this' | 'super' | 'new' Creator) | S:Expr | P:Args | 'I' | '::' (ID | 'new')
Args = (Expr (',' Expr)*)?
Primary = ID | NUM | STR | 'true' | 'false' | 'null' | 'this' | 'super' | P:Expr | 'new' Creator | Type '.' 'class' | Type '::' (ID | 'new') | 'switch' P:Expr B:Cases
Creator = Type (P:Args B:Members? | S:Expr+ S:Empty* | B:ArrInit)
"""

GO = """
Top = TopItem*
T = 'N' | ';' | EOF
TopItem = 'N' | ';' | 'package' ID T | 'import' (ImportSpec | P:ImportSpecs) T | Decl T | 'func' P:Params? ID S:TypeParams? P:Params Result? B:Stmts? T
ImportSpec = (ID | '.')? STR
ImportSpecs = (ImportSpec T)*
Decl = 'var' (VarSpec | P:VarSpecs) | 'const' (ConstSpec | P:ConstSpecs) | 'type' (TypeSpec | P:TypeSpecs)
VarSpec = ID (',' ID)* (Type ('=' Exprs)? | '=' Exprs)
VarSpecs = (VarSpec T)*
ConstSpec = ID (',' ID)* (Type? '=' Exprs)?
ConstSpecs = (ConstSpec T)*
TypeSpec = ID S:TypeParams? '='? Type
TypeSpecs = (TypeSpec T)*
TypeParams = TypeParam (',' TypeParam)* ','?
TypeParam = ID Constraint?
Constraint = '~'? Type ('|' '~'? Type)*
Result = P:Params | Type
Params = (Param (',' Param)*)? ','?
Param = Type | ID '...'? Type | '...' Type
Type = QID S:Types? | '*' Type | S:Empty Type | S:Len Type | 'map' S:Type Type | 'chan' '<-'? Type | '<-' 'chan' Type | 'func' P:Params Result? | 'struct' B:Fields | 'interface' B:Methods | P:Type
Types = Type (',' Type)* ','?
Len = Expr | '...'
Empty = EOF
QID = ID ('.' ID)?
Fields = (Field T)* | 'N'*
Field = ID (',' ID)* Type STR? | '*'? QID S:Types? STR?
Methods = (Method T)* | 'N'*
Method = ID P:Params Result? | Constraint
Stmts = (Stmt? ('N' | ';'))* Stmt?
Stmt = Decl | 'return' Exprs? | 'if' Head B:Stmts ('else' (Stmt | B:Stmts))? | 'for' ForHead? B:Stmts | 'switch' SwitchHead? B:Cases | 'select' B:Cases | 'go' Expr | 'defer' Expr | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | ID ':' Stmt? | B:Stmts | Simple
Simple = Exprs ((':=' | '=' | 'A') Exprs | 'I' | '<-' Expr)?
Head = (Simple? ';')? Expr
ForHead = Expr | Simple? ';' Expr? ';' Simple? | (Exprs (':=' | '='))? 'range' Expr
SwitchHead = Simple | Simple? ';' Simple?
Cases = 'N'* (('case' CaseHead | 'default') ':' Stmts)*
CaseHead = (Expr | Type) (',' (Expr | Type))* | Simple
Exprs = Expr (',' Expr)*
Expr = Unary (Bin Unary)*
Bin = 'o' | '+' | '-' | '*' | '/' | '%' | '&' | '^' | '|' | '<' | '>' | '<' '<' | '>' '>'
Unary = ('+' | '-' | '!' | '^' | '*' | '&' | '<-' | '~')* Operand Suffix*
Operand = NUM | STR | ID | P:Expr | P:Type | 'func' P:Params Result? B:Stmts | LitType B:Lit | Type P:Args
LitType = S:Empty Type | S:Len Type | 'map' S:Type Type | 'struct' B:Fields | QID S:Types?
Suffix = '.' ID | '.' P:Assert | S:Index | P:Args | B:Lit
Assert = 'type' | Type
Index = Expr? ':' Expr? (':' Expr)? | Types | Expr
Args = (Arg (',' Arg)* '...'? ','?)?
Arg = Expr | Type
Lit = (Elem (',' Elem)*)? ','?
Elem = (Val ':')? Val
Val = Expr | B:Lit
"""

PYTHON = """
Simple = Small (';' Small)* ';'?
Small = 'pass' | 'break' | 'continue' | 'return' Stars? | 'raise' (Test ('from' Test)?)? | ('global' | 'nonlocal') ID (',' ID)* | 'del' Stars | 'assert' Test (',' Test)? | Import | ExprStmt | 'type' ID S:TypeParams? '=' Test
Import = 'import' Dotted ('as' ID)? (',' Dotted ('as' ID)?)* | 'from' ('.' | '...')* Dotted? 'import' ('*' | Names | P:NamesC)
Dotted = ID ('.' ID)*
Names = ID ('as' ID)? (',' ID ('as' ID)?)*
NamesC = Names ','?
ExprStmt = Stars (':' Test ('=' Rhs)? | 'A' Rhs | ('=' Rhs)*)
Rhs = Stars | Yield
Yield = 'yield' ('from' Test | Stars)?
Stars = Star (',' Star)* ','?
Star = Test | '*' Test | Yield
Test = Or ('if' Or 'else' Test)? | 'lambda' Lambda? ':' Test
Lambda = LArg (',' LArg)* ','?
LArg = ID ('=' Test)? | '*' ID? | '**' ID | '/'
Or = Not (('and' | 'or') Not)*
Not = 'not'* Cmp
Cmp = Sum (CmpOp Sum)*
CmpOp = 'o' | '<' | '>' | 'in' | 'not' 'in' | 'is' | 'is' 'not'
Sum = Factor (BinOp Factor)*
BinOp = '+' | '-' | '*' | '/' | '%' | '&' | '^' | '|' | '@' | '**' | '<' '<' | '>' '>' | 'O'
Factor = ('+' | '-' | '~' | 'await')* Atom Trailer*
Trailer = '.' ID | P:Args | S:Subs
Atom = ID | NUM | STR+ | 'None' | 'True' | 'False' | '...' | P:Paren | S:List | B:Set
Named = Test | ID ':=' Test
Paren = (Elem (',' Elem)* ','?)? | Elem Comp+ | Yield
Elem = Named | '*' Or
List = (Elem (',' Elem)* ','?)? | Elem Comp+
Set = (Pair (',' Pair)* ','?)? | Elem (',' Elem)* ','? | (Elem | Test ':' Test) Comp+
Pair = Test ':' Test | '**' Or
Comp = 'async'? 'for' Targets 'in' Or Cond* | 'async'? 'for' Targets 'in' Or 'if' Or 'else' Test Cond*
Cond = 'if' (Or | ID ':=' Test | 'lambda' Lambda? ':' Test)
Targets = Target (',' Target)* ','?
Target = '*'? Sum
Args = (Arg (',' Arg)* ','?)? | Named Comp+
Arg = Named | ID '=' Test | '*' Test | '**' Test | Named Comp+
Subs = Sub (',' Sub)* ','?
Sub = Named | '*' Or | Test? ':' Test? (':' Test?)?
Params = (Param (',' Param)* ','?)?
Param = ID (':' Test)? ('=' Test)? | '*' (ID (':' '*'? Test)?)? | '**' ID (':' Test)? | '/'
TypeParams = (TypeParam (',' TypeParam)* ','?)
TypeParam = ('*' | '**')? ID (':' Test)? ('=' Test)?
HIf = 'if' Named ':'
HElif = 'elif' Named ':'
HElse = 'else' ':'
HFor = 'async'? 'for' Targets 'in' Stars ':'
HWhile = 'while' Named ':'
HTry = 'try' ':'
HExcept = 'except' '*'? (Test ('as' ID)? | Test (',' Test)+)? ':'
HFinally = 'finally' ':'
HWith = 'async'? 'with' (WithItem (',' WithItem)* | P:WithItems) ':'
WithItems = WithItem (',' WithItem)* ','?
WithItem = Test ('as' Target)?
HDef = 'async'? 'def' ID S:TypeParams? P:Params ('->' Test)? ':'
HClass = 'class' ID S:TypeParams? P:Args? ':'
HDeco = '@' Named
HMatch = 'match' Stars ':'
HCase = 'case' Patterns ('if' Named)? ':'
Patterns = PatternAs (',' PatternAs)* ','?
PatternAs = PatternOr ('as' ID)? | '*' ID
PatternOr = Pattern ('|' Pattern)*
Pattern = '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | ID ('.' ID)* P:PatArgs? | P:PatItems | S:PatItems | B:PatMap
PatItems = Patterns?
PatArgs = (PatArg (',' PatArg)* ','?)?
PatArg = (ID '=')? PatternAs
PatMap = (PatPair (',' PatPair)* ','?)?
PatPair = Pattern ':' PatternAs | '**' ID
IIf = HIf Simple
IElif = HElif Simple
IElse = HElse Simple
IFor = HFor Simple
IWhile = HWhile Simple
ITry = HTry Simple
IExcept = HExcept Simple
IFinally = HFinally Simple
IWith = HWith Simple
IDef = HDef Simple
IClass = HClass Simple
ICase = HCase Simple
Py2 = 'print' ('>' '>')? Stars? | 'exec' Test ('in' Stars)? | 'raise' Test ',' Test (',' Test)?
"""

#: Blocks of Python over kinds of logical lines.
PYTHON_BLOCKS = """
File = Stmt*
Suite = Stmt+
Stmt = 'Simple' | If | For | While | Try | With | Def | Match
If = ('HIf' B:Suite | 'IIf') ('HElif' B:Suite | 'IElif')* Else?
Else = 'HElse' B:Suite | 'IElse'
For = ('HFor' B:Suite | 'IFor') Else?
While = ('HWhile' B:Suite | 'IWhile') Else?
Try = ('HTry' B:Suite | 'ITry') (Excepts Else? Finally? | Finally)
Excepts = ('HExcept' B:Suite | 'IExcept')+
Finally = 'HFinally' B:Suite | 'IFinally'
With = 'HWith' B:Suite | 'IWith'
Def = 'HDeco'* ('HDef' B:Suite | 'IDef' | 'HClass' B:Suite | 'IClass')
Match = 'HMatch' B:CaseSuite
CaseSuite = ('HCase' B:Suite | 'ICase')+
"""

JSON = """
Value = STR | '-'? NUM | 'true' | 'false' | 'null' | B:Object | S:Array
Object = (Pair (',' Pair)*)?
Pair = STR ':' Value
Array = (Value (',' Value)*)?
"""

#: Lines of YAML behind their marks, over tokens: : behind a key, p plain and s quoted scalars, h the head of a
#: block scalar, z what can begin no scalar, brackets and commas of flow values. Each kind is a start symbol:
#: K a key without value, V a key with one, H a block scalar's key, X plain text, Q a quoted or flow value, G a block scalar.
YAML_LINES = """
K = Key ':'
V = Key ':' Value
H = Key ':' 'h'
X = 'p'
Q = 's' | Flow
G = 'h'
Key = 'p' | 's' | Flow
Value = 'p' | 's' | Flow
Flow = '[' (Item (',' Item)* ','?)? ']' | '{' (Pair (',' Pair)* ','?)? '}'
Item = '?'? Value | Key? ':' Value?
Pair = '?'? Key (':' Value?)? | ':' Value?
"""
#: Blocks of YAML over kinds of lines; L a list mark, E and W those of an explicit key and its value, what
#: follows a mark in its line is a block; D is a document mark.
YAML_BLOCKS = """
File = Node? ('D' Node?)*
Node = Map | List | Scalar
Map = Entry+
Entry = 'K' (B:Node | List)? | 'V' | 'H' | 'E' B:Node? ('W' B:Node?)?
List = ('L' B:Node?)+
Scalar = 'X' | 'Q' | 'G'
"""
#: A line of a properties file over u, hexadecimal digits (f), backslashes and other characters (c).
PROPERTIES = """
Line = (Char | '\\' ('\\' | 'c' | 'f' | 'u' 'f' 'f' 'f' 'f'))* '\\'?
Char = 'c' | 'f' | 'u'
"""
