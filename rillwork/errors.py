"""Errors that users can meet, and the messages of all error kinds."""

from __future__ import annotations

# Names and messages of pipeline errors, in order.
PIPELINE_MESSAGES = {
    "NoThreadHandle": "No thread handle",
    "FailedToJoinThread": "Failed to join thread",
    "NoSinkMessageSender": "No sink message sender",
    "NoSinkMessageReceiver": "No sink message receiver",
    "MessageSinkFailed": "Message sink failed",
    "NoSinkElement": "No sink element",
    "PipelineNotReady": "Pipeline is not ready",
    "NoSinkDatagramSender": "No sink datagram sender",
    "FailedToRecvFromParent": "Failed to recv from parent",
    "ReceivedInvalidDatagramFromParent": "Received invalid datagram from parent",
    "ReceivedInvalidDatagramFromSink": "Received invalid datagram from sink",
    "ReceiveFromSinkFailed": "Receive from sink failed",
    "MessageParentFailed": "Message parent failed",
    "NoParentMessageSender": "No parent message sender",
    "InvalidSinkType": "Invalid sink type",
    "FailedToSendDatagramToSink": "Failed to send datagram to sink",
}
# Names and messages of media errors, in order.
MEDIA_MESSAGES = {
    "FailedToOpenInput": "Failed to open input",
    "FailedToFindBestStream": "Failed to find best stream",
    "FailedToReadFrame": "Failed to read frame",
    "FailedToFindDecoder": "Failed to find decoder",
    "FailedToCreateDecoder": "Failed to create decoder",
    "FailedToCopyCodecParamsToDecoder": "Failed to copy codec params to decoder",
    "FailedToOpenCodec": "Failed to open codec",
    "FailedToAllocFrame": "Failed to alloc frame",
    "FailedToAllocPacket": "Failed to alloc packet",
    "FailedToSendPacketToDecoder": "Failed to send packet to decoder",
    "FailedToReceiveDecodedFrame": "Failed to receive decoded frame",
}


class PipelineError(Exception):
    """Any error of a pipeline; ``kind`` is its name in PIPELINE_MESSAGES."""

    kind = ""

    def __init__(self, detail: str = ""):
        super().__init__(PIPELINE_MESSAGES[self.kind] + (f": {detail}" if detail else ""))


class PipelineNotReady(PipelineError):
    kind = "PipelineNotReady"


class InvalidSinkType(PipelineError):
    kind = "InvalidSinkType"


class NoSinkElement(PipelineError):
    kind = "NoSinkElement"


class PipelineFinished(PipelineError):
    """Asked to go on after the end."""

    kind = "MessageSinkFailed"


class StageFailed(PipelineError):
    """A stage behind the source has stopped."""

    kind = "ReceiveFromSinkFailed"


class InvalidDatagram(PipelineError):
    kind = "ReceivedInvalidDatagramFromParent"


class SendError(PipelineError):
    """A datum could not be handed on; the detail says why."""

    def __init__(self, detail: str):
        Exception.__init__(self, f"SendError: {detail}")


class MediaError(PipelineError):
    """``media_kind`` is the error's name in MEDIA_MESSAGES."""

    def __init__(self, media_kind: str, detail: str = ""):
        self.media_kind = media_kind
        Exception.__init__(self, f"AVError: {MEDIA_MESSAGES[media_kind]}" + (f": {detail}" if detail else ""))
