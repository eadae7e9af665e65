"""Explicit schemas: boxes, elements, regions, commands, captures. Nothing is inferred."""

from __future__ import annotations

from pagewarden.functions.boxes import BOX
from pagewarden.operators.sessions import COMMAND

ELEMENT = f"struct<id:string,role:string,label:string,bbox:{BOX},attributes:map<string,string>,isVisible:boolean,isInteractive:boolean,redacted:boolean>"
REGION = f"struct<bbox:{BOX},category:string,confidence:double,method:string>"
VISUAL = f"struct<role:string,bbox:{BOX},confidence:double,matchedId:string,addedAs:string>"
PERCEPTION = f"struct<modelId:string,latencyMs:double,embedding:array<float>,uiModelId:string,uiLatencyMs:double,visualElements:array<{VISUAL}>,ocrModelId:string,ocrLatencyMs:double,ocrLines:int>"
VIEWPORT = "struct<width:double,height:double,scrollX:double,scrollY:double,devicePixelRatio:double>"
CAPTURE = (
    "protocolVersion string, sessionId string, stepIndex int, task string, page struct<url:string,title:string,capturedAt:string>, "
    f"viewport {VIEWPORT}, elements array<{ELEMENT}>, screenshot struct<mimeType:string,dataBase64:string,width:int,height:int>, redactions array<{REGION}>, "
    f"history array<{COMMAND}>, perception {PERCEPTION}, pageText string, profileFields array<struct<key:string,label:string>>"
)
LOG = (
    f"id bigint, receivedAt double, task string, sessionId string, stepIndex int, url string, title string, viewport {VIEWPORT}, elements array<{ELEMENT}>, redactions array<{REGION}>, "
    f"perception {PERCEPTION}, hasScreenshot boolean, screenshotMime string, screenshotSize array<int>, command {COMMAND}, error string, reasoningMs bigint, pageText string, profileFields array<struct<key:string,label:string>>"
)
