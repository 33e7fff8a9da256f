"""Grammars of the supported languages, written for :mod:`codestrata.llm.gll`.

They recognise syntax only. Expressions are flat lists of operands and operators where precedence decides no acceptance;
what it does decide (targets of assignments, comparisons that do not chain, ``??`` beside ``||``) is told apart. Small
rules are macros, which spares a node of the stack graph for each use.
"""

from __future__ import annotations

#: JavaScript and its dialects ``ts`` (types) and ``jsx`` (markup).
ECMA = r"""
# words that are names except in special places
@Soft := 'async' | 'of' | 'get' | 'set' | 'from' | 'as' | 'static' | 'let' | 'type' | 'interface' | 'declare' | 'namespace' | 'module' | 'abstract'
  | 'readonly' | 'public' | 'private' | 'protected' | 'override' | 'keyof' | 'infer' | 'is' | 'asserts' | 'satisfies' | 'unique' | 'implements'
  | 'global' | 'accessor' | 'await' | 'yield' | 'target' | 'meta' | 'out' | 'require' | 'assert' | 'using' ;
@Id := NAME | @Soft ;
@Word := @Id | 'break' | 'case' | 'catch' | 'class' | 'const' | 'continue' | 'debugger' | 'default' | 'delete' | 'do' | 'else' | 'enum' | 'export'
  | 'extends' | 'false' | 'finally' | 'for' | 'function' | 'if' | 'import' | 'in' | 'instanceof' | 'new' | 'null' | 'return' | 'super' | 'switch'
  | 'this' | 'throw' | 'true' | 'try' | 'typeof' | 'var' | 'void' | 'while' | 'with' ;
@Prefix := '!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' | 'new' ?ts{ | TypeAssertion } ;
@Assignment := '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '&=' | '^=' | '|=' | '&&=' | '||=' | '??=' | '>' '>='  | '>' '>' '>=' ;
@Binary := '+' | '-' | '*' | '/' | '%' | '**' | '<<' | '<' | '<=' | '>=' | '==' | '!=' | '===' | '!==' | '&' | '|' | '^' | 'instanceof' | 'in' | '>' | '>' '>' | '>' '>' '>' ;
@Primary := @Id | NUM | STR | REGEX | 'this' | 'super' | 'null' | 'true' | 'false' | PRIVATE 'in' Operand | TPL | Template | ArrayLit | ObjectLit | FunctionExpr | ClassExpr
  | '(' Expr ')' | 'new' '.' 'target' | 'import' '(' Assign (',' Assign)? ','? ')' | 'import' '.' 'meta' ?jsx{ | Markup } ;
@Postfix := '.' (@Word | PRIVATE) | '?.' (@Word | PRIVATE) | '?.'? '[' Expr ']' | '?.'? @Args | TPL | Template | '++' | '--'
  ?ts{ | '!' | '?.'? TypeArgs @Args | TypeArgs (TPL | Template) | ('as' | 'satisfies') Type | 'as' 'const' } ;
@Operand := @Prefix* @Primary (@Postfix)* ;

Module = ModuleItem+ ;
Script = Stmt+ ;
ModuleItem = Import | Export | Stmt ;

Import = 'import' ( STR | ?ts{ 'type'? } ( @Id | @Id ',' (Names | '*' 'as' @Id) | Names | '*' 'as' @Id ) 'from' STR
  ?ts{ | 'type'? @Id '=' ('require' '(' STR ')' | @Id ('.' @Word)*) } ) (('with' | 'assert') ObjectLit)? SEMI ;
Names = '{' (NameItem (',' NameItem)* ','?)? '}' ;
NameItem = ?ts{ 'type'? } (@Word | STR) ('as' (@Word | STR))? ;
Export = 'export' ( '*' ('as' (@Word | STR))? 'from' STR (('with' | 'assert') ObjectLit)? SEMI
  | ?ts{ 'type'? } Names ('from' STR (('with' | 'assert') ObjectLit)?)? SEMI
  | 'default' ( Assign-('function' 'class') SEMI | FunctionExpr | ClassExpr ?ts{ | 'abstract' ClassExpr | Interface } )
  | @Declaration ?ts{ | '=' Expr SEMI | 'as' 'namespace' @Id SEMI | 'type' '*' ('as' @Id)? 'from' STR SEMI | 'import' @Id '=' @Id ('.' @Word)* SEMI } )
  | Decorator+ 'export' 'default'? ?ts{ 'abstract'? } ClassExpr ;
@Declaration := VarStmt | FunctionDecl | ClassDecl ?ts{ | TypeDecl } ;

Block = '{' Stmt* '}' ;
Stmt = Block | ';' | @Declaration | Expr-('{' 'function' 'class') SEMI | @Id ':' Stmt
  | 'if' '(' Expr ')' Stmt ('else' Stmt)?
  | 'for' 'await'? '(' ( ForInit? ';' Expr? ';' Expr? | ForHead 'of' Assign | ForHead 'in' Expr ) ')' Stmt
  | ('while' | 'with') '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' (';' | )
  | ('break' | 'continue') @Id? SEMI | 'return' Expr? SEMI | 'throw' Expr SEMI | 'debugger' SEMI
  | 'switch' '(' Expr ')' '{' ('case' Expr ':' Stmt* | 'default' ':' Stmt*)* '}'
  | 'try' Block ( 'catch' ('(' Target ?ts{ (':' Type)? } ')')? Block ('finally' Block)? | 'finally' Block ) ;
ForInit = ('var' | 'let') @Declarator (',' @Declarator)* | 'const' @Constant (',' @Constant)* | Expr ;
ForHead = ('var' | 'let' | 'const' | 'await'? 'using') Target | Operand ;
Operand = @Operand ;
VarStmt = ('var' | 'let' | 'await'? 'using' ?ts{ | 'const' }) @Declarator (',' @Declarator)* SEMI | 'const' @Constant (',' @Constant)* SEMI ;
@Constant := Target ?ts{ '!'? (':' Type)? } '=' Assign ;
@Declarator := Target ?ts{ '!'? (':' Type)? } ('=' Assign)? ;
Target = @Id | '{' (TargetProp (',' TargetProp)* ','?)? '}' | '[' ','* (('...'? Target ('=' Assign)?) (','+ '...'? Target ('=' Assign)?)* ','*)? ']' ;
TargetProp = '...' Target | @Id ('=' Assign)? | (@Word | STR | NUM | '[' Assign ']') ':' Target ('=' Assign)? ;

FunctionDecl = 'async'? 'function' '*'? @Id ?ts{ TypeParams? } @Params ?ts{ ReturnType? } ( Block ?ts{ | SEMI } ) ;
FunctionExpr = 'async'? 'function' '*'? @Id? ?ts{ TypeParams? } @Params ?ts{ ReturnType? } ( Block ?ts{ | SEMI } ) ;
@Params := '(' (Param (',' Param)* ','?)? ')' ;
Param = Decorator* ?ts{ ('public' | 'private' | 'protected' | 'readonly' | 'override')* } '...'? (Target ?ts{ | 'this' }) ?ts{ '?'? (':' Type)? } ('=' Assign)? ;
Arrow = 'async'? ?ts{ TypeParams? } @Params ?ts{ ReturnType? } '=>' ArrowBody ;
ArrowBody = Block | Assign-('{') ;
ClassDecl = Decorator* ?ts{ 'abstract'? } 'class' @Id ClassRest ;
ClassExpr = Decorator* 'class' @Id? ClassRest ;
ClassRest = ?ts{ TypeParams? } ('extends' Heritage)? ?ts{ ('implements' Type (',' Type)*)? } '{' ClassMember* '}' ;
Heritage = @Primary ('.' (@Word | PRIVATE) | '[' Expr ']' | @Args ?ts{ | TypeArgs })* ;
@PropName := @Word | STR | NUM | PRIVATE | '[' Assign ']' ;
ClassMember = ';' | 'static' Block
  | Decorator* ( 'static' | 'async' | 'get' | 'set' | 'accessor' | '*' ?ts{ | 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare' } )* @PropName
    ( ?ts{ '?'? TypeParams? } @Params ?ts{ ReturnType? } ( Block ?ts{ | SEMI } ) | ?ts{ ('?' | '!')? (':' Type)? } ('=' Assign)? SEMI )
  ?ts{ | ('static' | 'readonly' | 'public' | 'private' | 'protected')* '[' @Id ':' Type ']' (':' Type)? SEMI } ;
Decorator = '@' ( @Id ('.' (@Word | PRIVATE))* @Args? | '(' Expr ')' ) ;

Expr = Assign (',' Assign)* ;
# arrow functions and assignments are no operands; only names, members and patterns can be assigned to; ?? does not mix with && and ||
@Chain := (@Operand (@Binary | '&&' | '||'))* @Operand | (@Operand (@Binary | '??'))* @Operand ;
@Assigned := @Id | ArrayLit | ObjectLit | '(' Expr ')' | 'new'* @Primary (@Postfix)* ( '.' (@Word | PRIVATE) | '[' Expr ']' ?ts{ | '!' } ) ;
Assign = 'yield' ('*'? Assign)? | @Id '=>' ArrowBody | 'async' @Id '=>' ArrowBody | Arrow | @Chain ('?' Assign ':' Assign)? | @Assigned @Assignment Assign ;
@Args := '(' (@Arg (',' @Arg)* ','?)? ')' ;
@Arg := '...'? Assign ;
ArrayLit = '[' ','* (@Arg (','+ @Arg)* ','*)? ']' ;
ObjectLit = '{' (@Prop (',' @Prop)* ','?)? '}' ;
@Prop := '...' Assign | @Id '=' Assign | @Id | (@Word | STR | NUM | '[' Assign ']') ':' Assign
  | ('async' | 'get' | 'set' | '*')* @PropName ?ts{ TypeParams? } @Params ?ts{ ReturnType? } Block ;
Template = TPL_HEAD Expr (TPL_MID Expr)* TPL_TAIL ;

?jsx{
Markup = '<' MTag ?ts{ TypeArgs? } MAttr* ( '/' '>' | '>' MChild* '<' '/' MTag '>' ) | '<' '>' MChild* '<' '/' '>' ;
MTag = (@Word) (('.' | ':') @Word)* ;
MAttr = @Word (':' @Word)? ('=' (STR | '{' Expr '}' | Markup))? | '{' '...' Assign '}' ;
MChild = MTEXT | Markup | '{' '...'? Expr? '}' ;
}

?ts{
?notjsx{ TypeAssertion = '<' Type '>' ; }
?jsx{ TypeAssertion = 'never-a-token' ; }
TypeDecl = Interface | 'type' @Id TypeParams? '=' Type SEMI | 'const'? 'enum' @Id '{' (EnumItem (',' EnumItem)* ','?)? '}'
  | ('namespace' | 'module') @Id ('.' @Id)* '{' ModuleItem* '}' | 'module' STR ('{' ModuleItem* '}' | SEMI)
  | 'declare' ( @Declaration | 'global' '{' ModuleItem* '}' | 'const' 'enum' @Id '{' (EnumItem (',' EnumItem)* ','?)? '}' )  ;
Interface = 'interface' @Id TypeParams? ('extends' Type (',' Type)*)? TypeBody ;
EnumItem = (@Word | STR | '[' Expr ']') ('=' Assign)? ;
TypeBody = '{' (TypeMember MSEP)* '}' ;
TypeMember = 'new'? TypeParams? @Params ReturnType? | ('readonly' | '+' 'readonly' | '-' 'readonly')? '[' @Id (':' Type | 'in' Type ('as' Type)?) ']' ('?' | '-' '?' | '+' '?')? (':' Type)?
  | ('readonly' | 'get' | 'set')* @PropName '?'? ( (':' Type)? | TypeParams? @Params ReturnType? ) ;
TypeParams = '<' TypeParam (',' TypeParam)* ','? '>' ;
TypeParam = ('const' | 'in' | 'out')* @Id ('extends' Type)? ('=' Type)? ;
TypeArgs = '<' Type (',' Type)* ','? '>' ;
ReturnType = ':' ( Type | 'asserts' (@Id | 'this') ('is' Type)? | (@Id | 'this') 'is' Type ) ;
Type = @TypeUnion ('extends' @TypeUnion '?' Type ':' Type)? | 'abstract'? 'new'? TypeParams? @Params '=>' ( Type | 'asserts'? (@Id | 'this') 'is' Type | 'asserts' (@Id | 'this') ) ;
@TypeUnion := ('|' | '&')? @TypePart (('|' | '&') @TypePart)* ;
@TypePart := ('keyof' | 'unique' | 'readonly' | 'infer')* TypeAtom ('[' Type? ']')* ;
TypeAtom = @Id ('.' @Word)* TypeArgs? | 'this' | 'void' | 'null' | 'true' | 'false' | '-'? NUM | STR | TPL | TPL_HEAD Type (TPL_MID Type)* TPL_TAIL
  | '(' Type ')' | TypeBody | '[' (TupleItem (',' TupleItem)* ','?)? ']' | 'typeof' ('import' '(' STR ')' | @Id | 'this') ('.' @Word)* TypeArgs?
  | 'import' '(' STR ')' ('.' @Word)* TypeArgs? ;
TupleItem = '...'? (@Word '?'? ':')? Type '?'? ;
}
"""

PYTHON = r"""
@Id := NAME | 'match' | 'case' | 'type' ;
@Const := NUM | 'None' | 'True' | 'False' | '...' ;
File = (NEWLINE | Stmt)+ ;
Stmt = Simple (';' Simple)* ';'? NEWLINE | Compound ;
Block = Simple (';' Simple)* ';'? NEWLINE | NEWLINE INDENT Stmt+ DEDENT ;
Simple = @StarExprs | (Targets '=')+ (@StarExprs | Yield) | Single ( ':' Expr ('=' (@StarExprs | Yield))? | @Aug (@StarExprs | Yield) ) | Yield
  | 'return' @StarExprs? | 'raise' (Expr ('from' Expr)?)? | 'pass' | 'break' | 'continue' | 'del' Deleted (',' Deleted)* ','? | 'assert' Expr (',' Expr)?
  | ('global' | 'nonlocal') @Id (',' @Id)* | 'import' Dotted ('as' @Id)? (',' Dotted ('as' @Id)?)*
  | 'from' ( ('.' | '...')* Dotted | ('.' | '...')+ ) 'import' ( '*' | ImportAs (',' ImportAs)* | '(' ImportAs (',' ImportAs)* ','? ')' )
  | 'type' @Id TypeParams? '=' Expr ;
@Aug := '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**=' ;
Dotted = @Id ('.' @Id)* ;
ImportAs = @Id ('as' @Id)? ;
Compound = ('@' @Named NEWLINE)* ( 'async'? 'def' @Id TypeParams? '(' ParamList? ')' ('->' Expr)? ':' Block | 'class' @Id TypeParams? ('(' @Given? ')')? ':' Block )
  | 'if' @Named ':' Block ('elif' @Named ':' Block)* ('else' ':' Block)? | 'while' @Named ':' Block ('else' ':' Block)?
  | 'async'? 'for' Targets 'in' @StarExprs ':' Block ('else' ':' Block)?
  | 'try' ':' Block ( ('except' '*'? (Expr ('as' @Id)?)? ':' Block)+ ('else' ':' Block)? ('finally' ':' Block)? | 'finally' ':' Block )
  | 'async'? 'with' ( WithItem (',' WithItem)* | '(' WithItem (',' WithItem)* ','? ')' ) ':' Block
  | 'match' @StarNamed (',' @StarNamed)* ','? ':' NEWLINE INDENT ('case' Patterns ('if' @Named)? ':' Block)+ DEDENT ;
WithItem = Expr ('as' Target)? ;
TypeParams = '[' TypeParam (',' TypeParam)* ','? ']' ;
TypeParam = ('*' | '**')? @Id (':' Expr)? ('=' @StarExpr)? ;
ParamList = ( ParamHead (',' ParamTail)? | ParamTail ) ','? ;
ParamHead = @Param (',' @Param)* ( (',' '/' (',' @Param)*)? (',' @Default)* | (',' @Default)+ ',' '/' (',' @Default)* ) | @Default (',' @Default)* (',' '/' (',' @Default)*)? ;
ParamTail = '*' @Id (':' @StarExpr)? (',' (@Param | @Default))* (',' ParamRest)? | '*' (',' (@Param | @Default))+ (',' ParamRest)? | ParamRest ;
@Param := @Id (':' Expr)? ;
@Default := @Id (':' Expr)? '=' Expr ;
ParamRest = '**' @Id (':' Expr)? ;
Patterns = ('*' @Id | Pattern) (',' ('*' @Id | Pattern))* ','? ;
Pattern = PatternAtom ('|' PatternAtom)* ('as' @Id)? ;
PatternAtom = '-'? NUM (('+' | '-') NUM)? | @Strings | 'None' | 'True' | 'False' | Dotted ('(' (PatternArg (',' PatternArg)* ','?)? ')')? | '(' Patterns? ')' | '[' Patterns? ']'
  | '{' ( PatternItem (',' PatternItem)* ','? )? '}' ;
PatternArg = (@Id '=')? Pattern ;
PatternItem = '**' @Id | ('-'? NUM (('+' | '-') NUM)? | @Strings | 'None' | 'True' | 'False' | Dotted) ':' Pattern ;
Yield = 'yield' (@StarExprs | 'from' Expr)? ;
@StarExprs := @StarExpr (',' @StarExpr)* ','? ;
@StarExpr := '*' Expr | Expr ;
@StarNamed := '*' Expr | @Named ;
@Named := @Id ':=' Expr | Expr ;
@Binary := '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' | '<<' | '>>' | '&' | '|' | '^' | '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' | 'is' 'not' | 'and' | 'or' ;
@Operand := ('+' | '-' | '~' | 'not' | 'await')* ( @Id | @Const | @Strings | '(' Inner? ')' | '[' Inner? ']' | '{' (Inner | Pairs)? '}' ) ( '.' @Id | Args | '[' Slices ']' )* ;
Expr = (@Operand @Binary)* @Operand ('if' (@Operand @Binary)* @Operand 'else' Expr)? | 'lambda' ParamsBare? ':' Expr ;
ParamsBare = ( BareHead (',' BareTail)? | BareTail ) ','? ;
BareHead = @Id (',' @Id)* ( (',' '/' (',' @Id)*)? (',' @Keyword)* | (',' @Keyword)+ ',' '/' (',' @Keyword)* ) | @Keyword (',' @Keyword)* (',' '/' (',' @Keyword)*)? ;
BareTail = '*' @Id (',' (@Id | @Keyword))* (',' '**' @Id)? | '*' (',' (@Id | @Keyword))+ (',' '**' @Id)? | '**' @Id ;
@Keyword := @Id '=' Expr ;
Inner = @StarNamed (Comp+ | (',' @StarNamed)* ','?) | Yield ;
Comp = 'async'? 'for' Targets 'in' Or ('if' Or)* ;
Or = (@Operand @Binary)* @Operand ('if' (@Operand @Binary)* @Operand 'else' Expr)? | @Id ':=' Expr | 'lambda' ParamsBare? ':' Expr ;
Deleted = @Id | @Member | '(' (Deleted (',' Deleted)* ','?)? ')' | '[' (Deleted (',' Deleted)* ','?)? ']' ;
Targets = '*'? Target (',' '*'? Target)* ','? ;
Target = @Id | '(' Targets? ')' | '[' Targets? ']' | @Member ;
@Member := ( @Id | @Const | @Strings | '(' Inner? ')' | '[' Inner? ']' | '{' (Inner | Pairs)? '}' ) ( '.' @Id | Args | '[' Slices ']' )* ( '.' @Id | '[' Slices ']' ) ;
Single = @Id | '(' Single ')' | @Member ;
Pairs = @Pair (Comp+ | (',' @Pair)* ','?) ;
@Pair := Expr ':' Expr | '**' Expr ;
Args = '(' ( @Given | Expr Comp+ | @Id ':=' Expr Comp+ )? ')' ;
@Given := ( @Arg (',' @Arg)* (',' NamedArgs)? | NamedArgs ) ','? ;
@Arg := '*' Expr | @Named ;
NamedArgs = @Keyword (',' (@Keyword | '*' Expr))* (',' '**' Expr (',' (@Keyword | '**' Expr))*)? | '**' Expr (',' (@Keyword | '**' Expr))* ;
Slices = Slice (',' Slice)* ','? ;
Slice = '*' Expr | @Named | Expr? ':' Expr? (':' Expr?)? ;
@Strings := (STR | FString)+ ;
FString = F_START (F_TEXT | Field)* F_END ;
Field = '{' (@StarExprs | Yield) '='? ('!' @Id)? (':' (F_TEXT | Field)*)? '}' ;
"""

RUST = r"""
@Id := NAME | 'union' | 'auto' | 'default' | 'raw' | 'macro_rules' | 'safe' ;
@Lit := NUM | STR | CHAR | 'true' | 'false' ;
File = (InnerAttr | Item)+ ;
InnerAttr = '#' '!' '[' Tree* ']' ;
Attr = '#' '[' Tree* ']' ;
Tree = '(' Tree* ')' | '[' Tree* ']' | '{' Tree* '}' | @Any ;
@Any := @Id | @Lit | LIFETIME | 'as' | 'async' | 'await' | 'break' | 'const' | 'continue' | 'crate' | 'dyn' | 'else' | 'enum' | 'extern' | 'fn' | 'for' | 'if' | 'impl' | 'in' | 'let'
  | 'loop' | 'match' | 'mod' | 'move' | 'mut' | 'pub' | 'ref' | 'return' | 'self' | 'Self' | 'static' | 'struct' | 'super' | 'trait' | 'type' | 'unsafe' | 'use' | 'where' | 'while' | 'yield'
  | '+' | '-' | '*' | '/' | '%' | '^' | '!' | '&' | '|' | '&&' | '||' | '<<' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<<=' | '=' | '==' | '!=' | '>' | '<' | '>=' | '<='
  | '@' | '.' | '..' | '...' | '..=' | ',' | ';' | ':' | '::' | '->' | '=>' | '#' | '$' | '?' | '~' | '\\' ;
@Braced := '{' Tree* '}' ;
Vis = 'pub' ( '(' ('crate' | 'self' | 'super' | 'in' @SimplePath) ')' )? ;
@SimplePath := '::'? @Seg ('::' @Seg)* ;
@Seg := @Id | 'self' | 'super' | 'crate' | 'Self' | '$' 'crate' ;
Item = Attr* ( Vis? ( 'use' UseTree ';' | 'mod' @Id (';' | '{' (InnerAttr | Item)* '}') | Fn | 'type' @Id Generics? (':' Bounds?)? Where? ('=' Type Where?)? ';'
    | 'const' (@Id | '_') (':' Type)? ('=' Expr)? ';' | 'static' 'mut'? @Id ':' Type ('=' Expr)? ';'
    | ('struct' | 'union') @Id Generics? ( Where? Fields | '(' (TupleField (',' TupleField)* ','?)? ')' Where? ';' | Where? ';' )
    | 'enum' @Id Generics? Where? '{' (Variant (',' Variant)* ','?)? '}'
    | 'unsafe'? 'auto'? 'trait' @Id Generics? (':' Bounds?)? Where? '{' InnerAttr* Item* '}' | 'trait' @Id Generics? '=' Bounds? Where? ';'
    | 'default'? 'unsafe'? 'impl' Generics? 'const'? '!'? Type ('for' Type)? Where? '{' InnerAttr* Item* '}'
    | 'unsafe'? 'extern' STR? '{' InnerAttr* Item* '}' | 'extern' 'crate' (@Id | 'self') ('as' (@Id | '_'))? ';' )
  | @SimplePath '!' @Id? ( '(' Tree* ')' ';' | '[' Tree* ']' ';' | @Braced ) ) ;
UseTree = '::'? ( '*' | '{' (UseTree (',' UseTree)* ','?)? '}' | @Seg ('::' @Seg)* ( '::' '*' | '::' '{' (UseTree (',' UseTree)* ','?)? '}' | 'as' (@Id | '_') )? ) ;
Fn = ('default' | 'const' | 'async' | 'unsafe' | 'safe')* ('extern' STR?)? 'fn' @Id Generics? '(' (FnParam (',' FnParam)* ','?)? ')' ('->' Type)? Where? (Block | ';') ;
FnParam = Attr* ( '&'? LIFETIME? 'mut'? 'self' (':' Type)? | PatternNoTop ':' (Type | '...') | '...' ) ;
Fields = '{' (Field (',' Field)* ','?)? '}' ;
Field = Attr* Vis? @Id ':' Type ;
TupleField = Attr* Vis? Type ;
Variant = Attr* Vis? @Id ( Fields | '(' (TupleField (',' TupleField)* ','?)? ')' )? ('=' Expr)? ;
Generics = '<' (GenericParam (',' GenericParam)* ','?)? '>' ;
GenericParam = Attr* ( LIFETIME (':' (LIFETIME ('+' LIFETIME)* '+'?)?)? | @Id (':' Bounds?)? ('=' Type)? | 'const' @Id ':' Type ('=' (Block | '-'? @Lit | @Id))? ) ;
Where = 'where' WhereItem? (',' WhereItem)* ','? ;
WhereItem = LIFETIME ':' (LIFETIME ('+' LIFETIME)* '+'?)? | ForAll? Type ':' Bounds? ;
ForAll = 'for' Generics ;
Bounds = Bound ('+' Bound)* '+'? ;
Bound = LIFETIME | ('?' | '~' 'const' | 'const' | 'async')? ForAll? TypePath | '(' ('?')? ForAll? TypePath ')' | 'use' Generics ;
Type = '&' LIFETIME? 'mut'? Type | '&&' LIFETIME? 'mut'? Type | '*' ('const' | 'mut') Type | '[' Type (';' Expr)? ']' | '(' (Type (',' Type)* ','?)? ')' | '!' | '_' | ('impl' | 'dyn') Bounds
  | ForAll? 'unsafe'? ('extern' STR?)? 'fn' '(' (FnTypeParam (',' FnTypeParam)* ','?)? ')' ('->' Type)? | ForAll? TypePath ('+' Bound)* | TypePath '!' ('(' Tree* ')' | '[' Tree* ']' | @Braced) ;
FnTypeParam = Attr* ((@Id | '_') ':')? Type | '...' ;
TypePath = '::'? @TypeSeg ('::' @TypeSeg)* | '<' Type ('as' TypePath)? '>' ('::' @TypeSeg)+ ;
@TypeSeg := @Seg ('::'? GenericArgs | '::'? '(' (Type (',' Type)* ','?)? ')' ('->' Type)?)? ;
GenericArgs = '<' (GenericArg (',' GenericArg)* ','?)? '>' ;
GenericArg = LIFETIME | Type | Block | '-'? @Lit | @Id GenericArgs? ('=' Type | ':' Bounds) ;
Pattern = '|'? PatternNoTop ('|' PatternNoTop)* ;
PatternNoTop = 'ref'? 'mut'? @Id ('@' PatternNoTop)? | '_' | '..' | '-'? @Lit | @PatEnd? ('..' | '..=' | '...') @PatEnd? | ('&' | '&&') 'mut'? PatternNoTop | '(' (Pattern (',' Pattern)* ','?)? ')'
  | '[' (Pattern (',' Pattern)* ','?)? ']' | @ExprPath ( '(' (Pattern (',' Pattern)* ','?)? ')' | '{' (PatField (',' PatField)* ','?)? '}' )? | @SimplePath '!' ('(' Tree* ')' | '[' Tree* ']' | @Braced)
  | 'const' Block ;
@PatEnd := '-'? @Lit | @ExprPath ;
PatField = Attr* ( '..' | (@Id | NUM) ':' Pattern | 'ref'? 'mut'? @Id ) ;
@ExprPath := '::'? @ExprSeg ('::' @ExprSeg)* | '<' Type ('as' TypePath)? '>' ('::' @ExprSeg)+ ;
@ExprSeg := @Seg ('::' GenericArgs)? ;
Block = '{' InnerAttr* ( ';' | Let | Item | Attr* Expr-('let') ';' | Attr* BlockLike | @SimplePath '!' @Braced )* (Attr* Expr-('let'))? '}' ;
Let = Attr* 'let' Pattern (':' Type)? ('=' Expr ('else' Block)?)? ';' ;
BlockLike = (LIFETIME ':')? ( ('unsafe' | 'const' | 'async' 'move'?)? Block | 'loop' Block | 'while' @Cond Block | 'for' Pattern 'in' @Cond Block ) | 'if' @Cond Block ('else' 'if' @Cond Block)* ('else' Block)?
  | 'match' @Cond '{' InnerAttr* Arm* LastArm? '}' ;
@Cond := Expr ;
Arm = Attr* Pattern ('if' Expr)? '=>' ( Expr ',' | BlockLike ','? ) ;
LastArm = Attr* Pattern ('if' Expr)? '=>' Expr ;
@Prefix := '-' | '!' | '*' | ('&' | '&&') ('raw' ('const' | 'mut'))? 'mut'? | '..' | '..=' | 'let' Pattern '=' ;
@Primary := @Lit | @ExprPath ( '{' (StructField (',' StructField)* ','?)? '}' )? | @SimplePath '!' ('(' Tree* ')' | '[' Tree* ']' | @Braced) | '(' (Attr* Expr (',' Attr* Expr)* ','?)? ')'
  | '[' (Expr (';' Expr | (',' Expr)* ','?))? ']' | BlockLike | Closure | ('break' LIFETIME? | 'return' | 'yield') Expr? | 'continue' LIFETIME? | '_' | '..' ;
@Postfix := '?' | '.' ('await' | NUM | (@Id | 'self') ('::' GenericArgs)?) | '(' (Expr (',' Expr)* ','?)? ')' | '[' Expr ']' | 'as' Type ;
@Tight := '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>' '>' ;
@Compare := '==' | '!=' | '<' | '>' | '<=' | '>=' ;
@Loose := '&&' | '||' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<='
  | '>' '>=' | '..' | '..=' ;
@Operand := (@Prefix)* @Primary (@Postfix)* ;
# comparisons do not chain
@Sum := (@Operand @Tight)* @Operand ;
Expr = ( @Sum (@Compare @Sum)? @Loose )* @Sum (@Compare @Sum)? '..'? ;
StructField = Attr* ( (@Id | NUM) (':' Expr)? | '..' Expr? ) ;
Closure = ForAll? 'static'? ('async')? 'move'? ( '||' | '|' (ClosureParam (',' ClosureParam)* ','?)? '|' ) ( '->' Type Block | Expr ) ;
ClosureParam = Attr* PatternNoTop (':' Type)? ;
"""

GO = r"""
@Lit := NUM | STR | CHAR ;
File = 'package' NAME ';' (Import ';')* (TopDecl ';')* ;
Import = 'import' ( ImportSpec | '(' (ImportSpec ';')* ImportSpec? ')' ) ;
ImportSpec = (NAME | '.')? STR ;
TopDecl = Decl | Func ;
Decl = 'const' ( ConstSpec | '(' (ConstSpec ';')* ConstSpec? ')' ) | 'var' ( VarSpec | '(' (VarSpec ';')* VarSpec? ')' ) | 'type' ( TypeSpec | '(' (TypeSpec ';')* TypeSpec? ')' ) ;
ConstSpec = @Names (Type? '=' @Exprs)? ;
VarSpec = @Names ( Type ('=' @Exprs)? | '=' @Exprs ) ;
TypeSpec = NAME TypeParams? '='? Type ;
@Names := NAME (',' NAME)* ;
TypeParams = '[' TypeParam (',' TypeParam)* ','? ']' ;
TypeParam = @Names Constraint ;
Constraint = '~'? Type ('|' '~'? Type)* ;
Func = 'func' @Params? NAME TypeParams? @Params Result? Block? ;
@Params := '(' (@Param (',' @Param)* ','?)? ')' ;
@Param := NAME? '...'? Type ;
Result = @Params | Type ;
Type = NAME ('.' NAME)? ('[' Type (',' Type)* ','? ']')? | '*' Type | '[' (Expr | '...')? ']' Type | 'map' '[' Type ']' Type | 'chan' '<-'? Type | '<-' 'chan' Type | 'func' @Params Result? | StructType | InterfaceType | '(' Type ')' ;
StructType = 'struct' '{' (FieldDecl ';')* FieldDecl? '}' ;
FieldDecl = ( @Names Type | '*'? NAME ('.' NAME)? ('[' Type (',' Type)* ']')? | '(' '*'? NAME ('.' NAME)? ')' ) STR? ;
InterfaceType = 'interface' '{' (InterfaceItem ';')* InterfaceItem? '}' ;
InterfaceItem = NAME @Params Result? | Constraint ;
Block = '{' (Stmt? ';')* Stmt? '}' ;
Stmt = Decl | SimpleStmt | NAME ':' Stmt? | ('go' | 'defer') Call | 'return' @Exprs? | ('break' | 'continue' | 'goto') NAME? | 'fallthrough' | Block | If
  | 'switch' ( SimpleStmt? ';' )? ( SimpleStmt )? '{' ( ('case' CaseList | 'default') ':' (Stmt? ';')* Stmt? )* '}'
  | 'select' '{' ( ('case' SimpleStmt | 'default') ':' (Stmt? ';')* Stmt? )* '}'
  | 'for' ( SimpleStmt? ';' SimpleStmt? ';' SimpleStmt? | (@Exprs ('=' | ':='))? 'range' Expr | Expr )? Block ;
CaseList = Expr (',' Expr)* ','? ;
If = 'if' (SimpleStmt? ';')? Expr Block ('else' (If | Block))? ;
SimpleStmt = @Exprs @Assign @Exprs | @Names ':=' @Exprs | Expr ( '++' | '--' | '<-' Expr )? ;
@Assign := '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=' ;
@Exprs := Expr (',' Expr)* ;
@Binary := '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^' ;
@Operand := ('+' | '-' | '!' | '^' | '*' | '&' | '<-' | '~')* ( @Lit | NAME Braces? | '(' @TypeOrExpr ')' | 'func' @Params Result? Block? | @TypeLit Braces? )
  ( '.' (NAME Braces? | '(' (Type | 'type') ')') | '[' Index ']' Braces? | @Args )* ;
@TypeLit := '[' (Expr | '...')? ']' Type | 'map' '[' Type ']' Type | 'chan' '<-'? Type | StructType | InterfaceType ;
Expr = (@Operand @Binary)* @Operand ;
Call = ( @Lit | NAME Braces? | '(' @TypeOrExpr ')' | 'func' @Params Result? Block? | @TypeLit Braces? ) ( '.' (NAME Braces? | '(' (Type | 'type') ')') | '[' Index ']' Braces? | @Args )* @Args ;
@TypeOrExpr := Expr | Type ;
Index = @TypeOrExpr (',' @TypeOrExpr)* ','? | Expr? ':' Expr? (':' Expr)? ;
@Args := '(' ( @TypeOrExpr (',' @TypeOrExpr)* '...'? ','? )? ')' ;
Braces = '{' ( Element (',' Element)* ','? )? '}' ;
Element = (Expr | Braces) (':' (Expr | Braces))? ;
"""
